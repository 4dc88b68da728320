"""Embedding near-duplicates through an inverted multi-index.

Unit vectors are cut in halves and each half has a codebook of its own; the
pairs of codes form a grid of cells. A vector is indexed in the cell of its
nearest codes and visits the cells in order of the sum of both distances
(multi-sequence order), as many as the target recall needs. What it meets there
is verified by the exact cosine in double precision.

Copies are one vector with a count. A cell with many vectors is divided into
blocks, and what leaves a block is a count of links for each vector and a star
of its components, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written
from .simhash import merge

COSINE = 0.93
#: Of pairs at exactly the least cosine, the hardest, so many are to be met.
RECALL = 0.99
#: The codebooks and the number of visits are fitted on so many vectors at most.
SAMPLE = 8192
#: Vectors of one label that a cell holds on average; codes of a codebook at most.
OCCUPANCY, MOST_CODES = 64, 1024
#: Indexed vectors and visitors in a block.
INDEXED, VISITING = 2048, 8192


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each code, without the row's own square."""
    return (codes * codes).sum(1) - 2 * (x @ codes.T)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    codes = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, codes).argmin(1)
        total, n = np.zeros_like(codes), np.bincount(own, minlength=k)
        np.add.at(total, own, x)
        codes[n > 0] = total[n > 0] / n[n > 0, None]
    return codes


@dataclass
class MultiIndex:
    left: np.ndarray
    right: np.ndarray
    visits: int = 1

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(x[:, : self.half], self.left), _nearest(x[:, self.half :], self.right)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def traverse(self, x: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` cells of each row in multi-sequence order. The i-th
        and j-th code can be among them only if (i + 1) (j + 1) <= n."""
        a, b = self.distances(x)
        i, j = np.meshgrid(np.arange(a.shape[1]), np.arange(b.shape[1]), indexing="ij")
        reach = (i + 1) * (j + 1) <= n
        i, j = i[reach], j[reach]
        oa, ob = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        sums = np.take_along_axis(a, oa, 1)[:, i] + np.take_along_axis(b, ob, 1)[:, j]
        first = sums.argsort(1, kind="stable")[:, :n]
        return oa[np.arange(len(x))[:, None], i[first]] * len(self.right) + ob[np.arange(len(x))[:, None], j[first]]


def fit_index(sample: np.ndarray, per_label: float, cosine: float = COSINE, recall: float = RECALL, seed: int = 5) -> MultiIndex:
    """Codebooks by k-means on the sample's halves; then the fewest visits with
    which one of a pair at exactly ``cosine`` reaches the other in ``recall`` of
    trial pairs made from the sample."""
    half = sample.shape[1] // 2
    k = int(min(MOST_CODES, max(1, len(sample) // 8), np.ceil(np.sqrt(max(1.0, per_label) / OCCUPANCY))))
    index = MultiIndex(kmeans(sample[:, :half], k), kmeans(sample[:, half:], k))
    rng = np.random.default_rng(seed)
    x = sample[: 1024]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(noise, axis=1, keepdims=True)
    y = cosine * x + np.sqrt(1 - cosine**2) * noise / np.where(size > 0, size, 1)
    most = min(k * k, 512)

    def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        hit = index.traverse(a, most) == index.home(b)[:, None]
        return np.where(hit.any(1), hit.argmax(1), k * k - 1)

    index.visits = int(np.quantile(np.minimum(rank(x, y), rank(y, x)), recall, method="higher")) + 1
    return index


def _place(index: MultiIndex, width: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(batch.schema.get_field_index("vec")), width)
            cells = index.traverse(x, index.visits)
            keep = [c for c in batch.schema.names if c != "vec"]
            flat = pa.array(x.ravel())
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), flat)
            visits = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32)), pa.array(cells.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], vec, pa.array(index.home(x).astype(np.int32)), visits], names=[*keep, "vec", "home", "visits"])

    return place


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows as unit vectors in double precision, filled up with zeros."""
    flat, n = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    x = np.zeros((len(n), width))
    x[np.arange(width) < n[:, None]] = flat
    x /= np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _verify(width: int, cosine: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def unit(t: pa.Table) -> pa.RecordBatch:
        side, cid, mult, home = (t.column(c).to_numpy() for c in ("side", "cid", "mult", "home"))
        vec = t.column("vec").combine_chunks()
        x = vec.flatten().to_numpy().reshape(-1, width)
        here, there = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        nodes, node = np.unique(cid, return_inverse=True)
        labels, count = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
        visits = t.column("visits").take(pa.array(here)).combine_chunks()
        wide = np.diff(visits.offsets.to_numpy())
        cells, owner = visits.flatten().to_numpy(), np.repeat(np.arange(len(here)), wide)
        homes, which = np.unique(home[there], return_inverse=True)
        mutual = np.zeros((len(here), len(homes)), bool)
        at = np.searchsorted(homes, cells)
        known = at < len(homes)
        known[known] = homes[at[known]] == cells[known]
        mutual[owner[known], at[known]] = True
        for k in range(0, len(there), 1024):
            q = there[k : k + 1024]
            hit = (x[q] @ x[here].T >= cosine) & (cid[q][:, None] != cid[here][None, :])
            if not hit.any():
                continue
            np.add.at(count, node[q], hit @ mult[here])
            # A visitor's link counts for the one it met too, unless that one visits it itself.
            np.add.at(count, node[here], mult[q] @ (hit & ~mutual[:, which[k : k + 1024]].T))
            i, j = np.nonzero(hit)
            merge(labels, node[q][i], node[here][j])
        far = np.flatnonzero(labels != np.arange(len(nodes)))
        some = np.flatnonzero(count)
        a = np.concatenate([nodes[far], nodes[some]])
        b = pa.array(np.concatenate([nodes[labels[far]], np.zeros(len(some), np.int64)]), mask=np.arange(len(a)) >= len(far))
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([np.zeros(len(far), np.int64), count[some]]))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; the last unit of a batch waits for the next."""
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            start = 0
            for cut in [*(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]:
                part = batch.slice(start, cut - start)
                if rest and rest[0].column(0)[0].as_py() != int(ids[start]):
                    yield unit(pa.Table.from_batches(rest))
                    rest = []
                rest.append(part)
                start = cut
        if rest:
            yield unit(pa.Table.from_batches(rest))

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row a vector: ``vec_id, n_links, component_id, kept``.

    Vectors are compared within a label and a length. A vector with a null
    label, or that is null, empty or zero or holds null or non-finite
    components, links with nothing and is its own component. A component's id
    is its smallest vec_id that is not null. Repeated ids keep their rows; an
    empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    x = F.col("embedding").cast("array<double>")
    rows = embeddings.select("vec_id", "label", F.transform(x, lambda v: v + F.lit(0.0)).alias("vec"))  # -0.0 becomes 0.0
    sound = F.col("label").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("vec", lambda v: v != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    good = rows.where("sound").withColumn("cid", F.xxhash64("label", "vec"))
    lone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = written(good.groupBy("cid").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("least")), "vec-classes")
    shape = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    if not shape["n"]:
        return lone
    width = shape["width"] + shape["width"] % 2
    kinds = classes.select("label", F.size("vec")).distinct().count()
    sample = classes.orderBy("cid").limit(SAMPLE).select("vec").toArrow().column("vec").combine_chunks()
    index = fit_index(_matrix(sample, width), shape["n"] / kinds, cosine, recall)
    kept = classes.select("cid", F.xxhash64("label", F.size("vec")).alias("kind"), "mult", "vec")
    placed = written(kept.mapInArrow(_place(index, width), "cid long, kind long, mult long, vec array<double>, home int, visits array<int>"), "vec-placed")
    cells = placed.groupBy("kind", F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("ni"))
    seen = placed.select("kind", F.explode("visits").alias("cell")).groupBy("kind", "cell").agg(F.count(F.lit(1)).alias("nq"))
    cells = written(cells.join(seen, ["kind", "cell"]).select("kind", "cell", F.ceil(F.col("ni") / INDEXED).cast("int").alias("ip"), F.ceil(F.col("nq") / VISITING).cast("int").alias("qp")), "vec-cells")
    none = F.lit(None).cast("array<int>")
    part = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    indexed = placed.withColumn("cell", F.col("home")).join(cells, ["kind", "cell"]).withColumn("i", part("ip")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qp") - 1))).withColumn("side", F.lit(0))
    visiting = placed.withColumn("cell", F.explode("visits")).withColumn("visits", none).join(cells, ["kind", "cell"]).withColumn("q", part("qp")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ip") - 1))).withColumn("side", F.lit(1))
    cols = [F.xxhash64("kind", "cell", "i", "q").alias("unit"), "side", "cid", "mult", "home", "vec", "visits"]
    units = indexed.select(*cols).unionByName(visiting.select(*cols)).repartition("unit").sortWithinPartitions("unit")
    found = written(units.mapInArrow(_verify(width, cosine), "a long, b long, n long"), "vec-found")
    linked = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    named = classes.select("cid", "mult", "least").join(linked, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = written(named, "vec-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(least, "root").select("cid", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "vec-result")
    out = good.select("vec_id", "cid").join(named, "cid").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.unionByName(lone)
