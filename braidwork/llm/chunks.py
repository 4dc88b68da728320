"""Substring deduplication by content-defined chunking.

A gear rolling hash over the bytes cuts a text where its top bits are zero, so
an insertion moves only the cuts next to it. Where that leaves a long gap, as in
periodic text, fewer bits are asked for. Chunks are deduplicated by digest:
the one in the document with the smallest id stays, and runs of chunks that an
earlier document has are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Bytes of a chunk: at least, at most; a cut falls at one byte in 2**BITS beyond the least.
LEAST, MOST, BITS = 32, 1024, 4
#: Bytes without a cut from which on fewer bits do.
GAP = 96
#: Bytes of a run of repeated chunks from which on it counts; shorter ones are common phrases.
RUN = 96
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 32 bytes up to each byte, h = 2 h + G[byte]."""
    h, span = _GEAR[data], 1
    while span < 32:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def candidates(h: np.ndarray) -> np.ndarray:
    """Ends of possible chunks of one text with the gear hashes ``h``. The first
    LEAST bytes have none, so what stands before the text never matters."""
    own = h[LEAST - 1 :]
    ends = np.flatnonzero(own >> np.uint32(32 - BITS) == 0) + LEAST
    for bits in (2, 1):
        edges = np.concatenate([[0], ends, [len(h)]])
        wide = np.diff(edges) > GAP
        if not wide.any():
            break
        more = np.flatnonzero(own >> np.uint32(32 - bits) == 0) + LEAST
        ends = np.union1d(ends, more[wide[np.minimum(np.searchsorted(edges, more) - 1, len(wide) - 1)]])
    return ends


def cut(ends: np.ndarray, begin: int, end: int) -> list[int]:
    """Cuts of one text from the candidates ``ends``."""
    cuts, last = [], begin
    for c in ends.tolist():
        while c - last > MOST:
            last += MOST
            cuts.append(last)
        if c - last >= LEAST:
            cuts.append(c)
            last = c
    while end - last > MOST:
        last += MOST
        cuts.append(last)
    if last < end:
        cuts.append(end)
    return cuts


_COLUMNS = "row long, start long, size int, digest long, more long"


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows to be cut together: 4 MB, or one longer text."""
    at = held = 0
    for k, size in enumerate(pc.binary_length(texts).to_pylist()):
        if k > at and held + size > 4 << 20:
            yield at, k
            at, held = k, 0
        held += size
    if at < len(texts):
        yield at, len(texts)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        for at, to in _slices(texts):
            part = [t.as_py() for t in texts.slice(at, to - at)]
            blob = b"".join(part)
            data = np.frombuffer(blob, np.uint8)
            h = gear(data)
            row, start, size, digest, owner = [], [], [], [], []
            begin = 0
            for k, t in enumerate(part):
                end = begin + len(t)
                cuts = cut(candidates(h[begin:end]) + begin, begin, end)
                froms = [begin, *cuts[:-1]]
                digest += [xxhash.xxh3_128_digest(blob[a:b]) for a, b in zip(froms, cuts, strict=False)]
                start += [a - begin for a in froms[: len(cuts)]]
                size += [b - a for a, b in zip(froms, cuts, strict=False)]
                owner += [at + k] * len(cuts)
                begin = end
            row = batch.column(2).take(pa.array(owner, pa.int64()))
            ids = batch.column(0).take(pa.array(owner, pa.int64()))
            both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ids, row, pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc_id", "row", "start", "size", "digest", "more"])


def chunked(docs: DataFrame) -> DataFrame:
    """``doc_id, row, start, size, digest, more`` (the digest's 128 bits) of all
    chunks of all texts; ``row`` tells texts of one id apart. Null and empty
    texts have none, nor have rows without an id any part: they neither repeat
    nor are repeated. A very long text is cut like any other, in one piece of
    memory."""
    text = F.encode(F.col("text").cast("string"), "UTF-8")
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id"), text.alias("data"), F.xxhash64("text").alias("row"))
    return rows.mapInArrow(_chunks, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_COLUMNS}")


def repeats(docs: DataFrame, run: int = RUN) -> DataFrame:
    """The repeated runs: ``doc_id, row, start, end, first_ids``.

    Each chunk of a run stands in a document with a smaller id; ``first_ids``
    are the smallest such ids. Only a chunk's first and last document are
    aggregated before chunks are joined, and only chunks that two documents
    have come out of the join.
    """
    chunks = written(chunked(docs), "chunks")
    shared = chunks.groupBy("digest", "more", "size").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    again = chunks.join(written(shared, "chunks-shared"), ["digest", "more", "size"]).where("doc_id > first_id")
    again = again.groupBy("doc_id", "row", "start").agg(F.max("size").alias("size"), F.min("first_id").alias("first_id"))
    order = Window.partitionBy("doc_id", "row").orderBy("start")
    fresh = F.coalesce(F.lag(F.col("start") + F.col("size")).over(order) != F.col("start"), F.lit(True)).cast("int")
    runs = again.withColumn("fresh", fresh).withColumn("k", F.sum("fresh").over(order))
    runs = runs.groupBy("doc_id", "row", "k").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.array_sort(F.collect_set("first_id")).alias("first_ids"))
    return runs.where(F.col("end") - F.col("start") >= run).drop("k")


def duplicated(docs: DataFrame, run: int = RUN) -> DataFrame:
    """One row for each document with repeated runs: ``doc_id, n_spans,
    n_removed, spans, first_ids``; documents without one have no row. ``run`` is
    how many bytes a run of repeated chunks needs, RUN by default: less is a
    common phrase. Rows of one id with other texts count apart and take nothing
    from each other, copies of a row are one; other columns are not read; an
    empty table gives an empty result."""
    one = F.struct("start", "end")
    found = repeats(docs, run).groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("end") - F.col("start")).alias("n_removed"), F.array_sort(F.collect_list(one)).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("first_ids")))).alias("first_ids"))
    return found.select("doc_id", "n_spans", "n_removed", F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(":"), r["end"])), ",").alias("spans"), "first_ids")


def deduplicated(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``docs`` with the repeated runs cut out of the texts (at byte places; a
    character that a cut divides is dropped)."""
    runs = repeats(docs, run).groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_bw_runs"))
    runs = written(runs.select(F.col("doc_id").alias("_bw_id"), F.col("row").alias("_bw_hash"), "_bw_runs"), "chunks-runs")
    data = F.encode(F.col("text").cast("string"), "UTF-8")
    keyed = docs.withColumn("_bw_hash", F.xxhash64("text"))
    found = keyed.join(runs.withColumnRenamed("_bw_hash", "_bw_row"), (F.col("doc_id") == F.col("_bw_id")) & (F.col("_bw_hash") == F.col("_bw_row")), "left")
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    kept = F.aggregate(
        "_bw_runs",
        state,
        lambda s, r: F.struct(F.concat(s["out"], _piece(data, s["at"], r["start"])).alias("out"), r["end"].alias("at")),
        lambda s: F.concat(s["out"], _piece(data, s["at"], F.octet_length(data).cast("long"))),
    )
    return found.withColumn("text", F.when(F.col("_bw_runs").isNull(), F.col("text")).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _piece(data, begin, end):
    return F.replace(F.try_validate_utf8(F.substring(data, (begin + 1).cast("int"), (end - begin).cast("int")).cast("string")), F.lit("�"), F.lit(""))
