"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length in words. A source's target is
so many whole passes and a remaining budget; the budget is met by a seeded
share of each length, and the rest of it by bounded-knapsack dynamic
programming over the length counts. Which documents of a length are taken
follows from a seeded hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, row_key, written

#: Fixed value: the weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Words that are left to the dynamic programme at first.
LAST_WORDS = 32_768
#: Places of its table: a longer rest is counted in coarser units first.
CELLS = 1 << 22
#: Documents of one source and length are ranked in so many parts.
SALTS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """``source, source_size`` to the same with ``target``.

    Sources by code point, null last, have ``weights`` in turn and share all
    words. A target above ``most`` times its source stops there and the excess
    is shared again: in order of size over weight, the sources are full up to
    the first whose share of what is left fits. The windows run over one row a
    source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = weighed.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("rest", F.sum("w").over(on))
    weighed = weighed.withColumn("level", F.col("left") / F.col("rest")).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    weighed = weighed.withColumn("place", F.row_number().over(order))
    level = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(every)["level"]
    return weighed.withColumn("lambda", level).select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("lambda") * F.col("w")).alias("target"))


def fit(lengths: list[int], counts: list[int], budget: int, last: int = LAST_WORDS, cells: int = CELLS) -> list[int]:
    """How many documents of each length to take so that their words come to
    ``budget`` or as little below as the search finds.

    A share of each count goes first, so that the mix keeps the source's spread
    of lengths, and leaves a reserve to the knapsack. If a small reserve
    (``last`` words at most) is not met exactly, one of twice the longest
    document is tried, which lets in every document that fits the budget, and
    the whole budget, where the knapsack counts that in words.
    """
    own = sorted((k for k in range(len(lengths)) if lengths[k] > 0 and counts[k] > 0), key=lambda k: -lengths[k])
    total = sum(lengths[k] * counts[k] for k in own)
    budget = max(0, min(budget, total))
    best, gap = [0] * len(lengths), budget
    if not budget:
        return best
    for reserve in sorted({min(last, budget // 8), min(budget, 2 * lengths[own[0]]), budget if budget <= cells else 0}):
        take = [0] * len(lengths)
        for k in own:
            take[k] = counts[k] * (budget - reserve) // total
        rest = budget - sum(lengths[k] * take[k] for k in own)
        for k, n in knapsack([(k, lengths[k], counts[k] - take[k]) for k in own], rest, cells).items():
            take[k] += n
            rest -= n * lengths[k]
        if rest < gap:
            best, gap = take, rest
        if not gap:
            break
    return best


def knapsack(free: list[tuple[int, int, int]], rest: int, cells: int = CELLS) -> dict[int, int]:
    """How many to take of ``free`` (key, length, count; the longest first) to
    come as near to ``rest`` from below as dynamic programming finds.

    A rest of up to ``cells`` words is filled as well as it can be. Of a longer
    one, single documents from the longest down leave three of the longest at
    most; the table then counts coarser units, lengths rounded up, and what the
    rounding leaves is filled in turn.
    """
    took: dict[int, int] = {}
    while True:
        free = [(k, n, min(c, rest // n)) for k, n, c in free if min(c, rest // n) > 0]
        if not free:
            return took
        unit, now = -(-rest // cells), {}
        left = rest - 2 * free[0][1]
        for k, n, c in free if unit > 1 else []:
            if left >= n:
                now[k] = min(c, left // n)
                left -= now[k] * n
        if not now:
            now = _table([f for f in free if f[1] >= unit] or free, rest, unit) or {free[0][0]: 1}
        else:
            unit = 0
        rest -= sum(n * now.get(k, 0) for k, n, _ in free)
        free = [(k, n, c - now.get(k, 0)) for k, n, c in free]
        for k, n in now.items():
            took[k] = took.get(k, 0) + n
        if unit == 1:
            return took


def _table(free: list[tuple[int, int, int]], rest: int, unit: int) -> dict[int, int]:
    """The best sum by dynamic programming; counts are split in powers of two."""
    grain = math.gcd(*[n for _, n, _ in free]) if unit == 1 else unit
    size, top = rest // grain, 0
    via, items = np.full(size + 1, -1, np.int32), []
    via[0] = 0
    for k, n, count in free:
        cost, part = -(-n // grain), 1
        while count > 0 and via[size] < 0:
            now = min(part, count)
            count, part, step = count - now, part * 2, cost * now
            if step > size:
                continue
            items.append((k, now, step))
            top = min(size, top + step)
            new = (via[: top + 1 - step] >= 0) & (via[step : top + 1] < 0)
            via[step : top + 1][new] = len(items)
    at, took = int(np.flatnonzero(via >= 0)[-1]), {}
    while at:  # an item reaches a sum only from one that earlier items reach
        k, n, step = items[via[at] - 1]
        took[k] = took.get(k, 0) + n
        at -= step
    return took


def _quotas(group: pd.DataFrame) -> pd.DataFrame:
    """Whole passes of each length, and how many documents get one more. Where
    the documents of one pass leave a gap (one long text may be most of a
    source), further passes of others may fill it."""
    size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    lengths, counts = [int(x) for x in group["size"]], [int(x) for x in group["n"]]
    base = min(MOST_PASSES, int(target // size)) if size else 1
    extra = [0] * len(lengths)
    if size and base < MOST_PASSES:
        budget = min(size, round(target - base * size))
        extra = fit(lengths, counts, budget)
        gap = budget - sum(n * x for n, x in zip(lengths, extra, strict=True))
        if gap:
            more = fit(lengths, [(MOST_PASSES - base) * c - x for c, x in zip(counts, extra, strict=True)], gap)
            extra = [x + y for x, y in zip(extra, more, strict=True)]
    whole = [base + x // c for x, c in zip(extra, counts, strict=True)]
    return pd.DataFrame({"skey": group["skey"], "size": group["size"], "passes": whole, "extra": [x % c for x, c in zip(extra, counts, strict=True)]})


def passes(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row a document: ``doc_id, row, size, source_size, target, times``.

    ``times`` is how often the mix takes the document, 0 to 3; ``row`` is a
    hash of its columns. The counts by length are one group a source, of as
    many rows as it has lengths (the square root of its words bounds that).
    Documents of one source and length are ranked in SALTS parts by the seeded
    hash of their id, each part with its share of the length's quota, so no
    group is ranked in one task. Null ids and repeated rows count like others;
    an empty table gives an empty result.
    """
    skey = F.concat(F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col("source").cast("string"), F.lit("")))
    flat = docs.select("doc_id", row_key(docs).alias("row"), "source", skey.alias("skey"), word_count(F.col("text").cast("string")).alias("size"))
    flat = flat.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "row")).withColumn("salt", F.pmod("draw", F.lit(SALTS)).cast("int"))
    flat = written(flat, "mix-sizes")
    parts = written(flat.groupBy("skey", "size", "salt").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source")), "mix-parts")
    counts = parts.groupBy("skey", "size").agg(F.sum("n").alias("n"), F.first("source").alias("source"))
    goal = targets(counts.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.first("source").alias("source")), weights)
    goal = goal.withColumn("skey", F.concat(F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col("source").cast("string"), F.lit("")))).drop("source")
    quota = counts.join(goal, "skey").groupBy("skey").applyInPandas(_quotas, "skey string, size long, passes int, extra long").join(goal, "skey")
    before = Window.partitionBy("skey", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    part = parts.drop("source").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(quota, ["skey", "size"])
    part = written(part.withColumn("own", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before")))).drop("n", "before", "extra"), "mix-quota")
    rank = F.row_number().over(Window.partitionBy("skey", "size", "salt").orderBy("draw", "doc_id", "row"))
    return flat.withColumn("rank", rank).join(part, ["skey", "size", "salt"]).select("doc_id", "row", "size", "source_size", "target", (F.col("passes") + (F.col("rank") <= F.col("own")).cast("int")).alias("times"))


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each document as many times as it is taken.

    Rows equal in all columns are exchangeable: they are merged first and then
    repeated by the sum of their times, so that the joins stay one to many.
    """
    taken = passes(docs, seed).groupBy(F.col("doc_id").alias("_bw_id"), F.col("row").alias("_bw_row")).agg(F.sum("times").cast("int").alias("_bw_times"), F.count(F.lit(1)).alias("_bw_n"))
    taken = written(taken.where("_bw_times > 0"), "mix-taken")
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("_bw_row", row_key(docs)).withColumn("_bw_key", F.struct(F.col("doc_id"), F.col("_bw_row")))
    taken = taken.withColumn("_bw_key", F.struct(F.col("_bw_id").alias("doc_id"), F.col("_bw_row"))).drop("_bw_row", "_bw_id")
    found = keyed.join(taken.hint("merge"), "_bw_key")  # alike at every size: texts move once
    single = found.where("_bw_n = 1")
    if not empty_many(taken):
        single = single.unionByName(found.where("_bw_n > 1").dropDuplicates(["_bw_row"]))
    return single.withColumn("_bw_copy", F.explode(F.sequence(F.lit(1), F.col("_bw_times")))).select(*own)


def empty_many(taken: DataFrame) -> bool:
    return len(taken.where("_bw_n > 1").take(1)) == 0
