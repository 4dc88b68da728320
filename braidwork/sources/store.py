"""Stores of run positions: layers of changed runs, and a manifest of them.

A commit writes one layer, the rows of the runs that changed, and then claims
the next version: the manifest is written beside its place and renamed into it,
which fails where another commit has done so first. That one checks its runs'
revisions again and claims the version after, or is in conflict; whoever loses
writes nothing that readers see. Readers open the newest manifest and take each
run from the newest layer that has it; every so many layers are written as one.
All paths go through Hadoop's file systems; a store whose rename replaces what
is there without notice needs another claim.
"""

from __future__ import annotations

import json
import time
import uuid
from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators.delta import conflicts
from ..operators.schema import FORMAT_VERSION, HEADER, Position, fields_of, rows_ddl
from .tables import merged, written

#: Layers that are read as they are; one more and they are written as one.
LAYERS = 8
_ROW = (*HEADER, "inv", "grp")
_HEAD = [c for c in HEADER if c != "final"]


class ConflictError(RuntimeError):
    """The expected revision is not the stored one; nothing was written."""


class NotFoundError(KeyError):
    pass


class CorruptError(ValueError):
    pass


class Store(ABC):
    @abstractmethod
    def create(self, pos: Position) -> None: ...

    @abstractmethod
    def load(self, run_ids: DataFrame | None = None) -> Position: ...

    @abstractmethod
    def load_header(self) -> DataFrame: ...

    @abstractmethod
    def commit(self, pos: Position, expected: DataFrame) -> None: ...

    @abstractmethod
    def delete(self, run_ids: DataFrame) -> None: ...


def newest(layers: list[DataFrame], columns: list[str] | tuple[str, ...] = _ROW) -> DataFrame:
    """Each run as its newest layer has it, ``layers`` from the oldest. Only run
    ids are shuffled to find it, and nothing where there is one layer."""
    if len(layers) == 1:
        return layers[0].where("not deleted").select(*columns)
    marked = [t.withColumn("layer", F.lit(k)) for k, t in enumerate(layers)]
    last = reduce(DataFrame.unionByName, [t.select("run_id", "layer") for t in marked]).groupBy("run_id").agg(F.max("layer").alias("layer"))
    every = reduce(DataFrame.unionByName, [t.select("deleted", "layer", *columns) for t in marked])
    return every.join(merged(last), ["run_id", "layer"], "left_semi").where("not deleted").select(*columns)


class LayeredStore(Store):
    """What both stores do; they differ in where layers lie."""

    def _layers(self) -> list[DataFrame]:
        """The layers as of now, from the oldest; raises where there is none."""
        raise NotImplementedError

    def _add(self, layer: DataFrame, check) -> None:
        """Add a layer if ``check`` passes on the layers it comes on top of."""
        raise NotImplementedError

    @staticmethod
    def _layer(rows: DataFrame) -> DataFrame:
        return rows.select(*_ROW).withColumn("deleted", F.lit(False))

    def create(self, pos: Position) -> None:
        def check(layers: list[DataFrame]) -> None:
            if layers and newest(layers, _HEAD).join(merged(pos.rows.select("run_id")), "run_id", "left_semi").limit(1).take(1):
                raise ConflictError("a run exists already")

        self._add(self._layer(pos.rows), check)

    def load(self, run_ids: DataFrame | None = None) -> Position:
        layers = self._layers()
        if run_ids is not None:
            layers = [t.join(merged(run_ids.select("run_id")), "run_id", "left_semi") for t in layers]
        return Position(rows=newest(layers))

    def load_header(self) -> DataFrame:
        """Headers only: no state is read."""
        return newest(self._layers(), _HEAD)

    def commit(self, pos: Position, expected: DataFrame) -> None:
        """Replace the runs of ``pos`` if all stored revisions are the
        ``expected (run_id, revision)``; else nothing is written."""
        asked = expected.select("run_id", F.col("revision").alias("expected"))

        def check(layers: list[DataFrame]) -> None:
            if not layers:
                raise NotFoundError("the store is empty")
            if conflicts(newest(layers, _HEAD), asked).limit(1).take(1):
                raise ConflictError("a run is not at the expected revision")

        self._add(self._layer(pos.rows), check)

    def delete(self, run_ids: DataFrame) -> None:
        ids = run_ids.select("run_id").distinct()

        def check(layers: list[DataFrame]) -> None:
            if not layers or ids.join(merged(newest(layers, _HEAD)), "run_id", "left_anti").limit(1).take(1):
                raise NotFoundError("a run is not stored")

        like = self._layers()[0]
        gone = ids.select(*[F.col("run_id") if f.name == "run_id" else F.lit(True).alias("deleted") if f.name == "deleted" else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema])
        self._add(gone, check)


class MemoryStore(LayeredStore):
    """Positions held by the session, as written tables."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def _layers(self) -> list[DataFrame]:
        if not self.held:
            raise NotFoundError("the store is empty")
        return self.held

    def _add(self, layer: DataFrame, check) -> None:
        check(self.held)
        held = [*self.held, written(layer, "memory")]
        self.held = held if len(held) <= LAYERS else [written(self._layer(newest(held)), "memory")]


class ParquetStore(LayeredStore):
    """Positions under ``path``; the manifest names the state's type, which a
    reader compares with its own."""

    def __init__(self, spark: SparkSession, path: str, state: str):
        if not path.strip("/"):
            raise ValueError("a store needs a folder of its own")
        self.spark, self.path, self.state = spark, path.rstrip("/"), state
        self.ddl = rows_ddl(state) + ", deleted boolean"

    @staticmethod
    def open(spark: SparkSession, path: str, state: str) -> ParquetStore:
        """A store at a path whose parent is there; what it holds must fit."""
        store = ParquetStore(spark, path, state)
        fs, where = store._fs(store.path)
        if where.getParent() is None or not fs.exists(where.getParent()):
            raise FileNotFoundError(f"the folder above {path} does not exist")
        if store.head():
            store._layers()
        return store

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _versions(self) -> list[int]:
        fs, where = self._fs(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def head(self) -> int:
        return max(self._versions(), default=0)

    def _manifest(self, version: int) -> dict:
        rows = self.spark.read.text(f"{self.path}/manifest/{version:012d}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def _claim(self, version: int, entry: dict) -> None:
        """Write the manifest beside its place and rename it without replacing."""
        jvm, name = self.spark.sparkContext._jvm, f"{self.path}/manifest/{version:012d}.json"
        fs, aside = self._fs(f"{self.path}/claims/{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        _, where = self._fs(name)
        fs.mkdirs(where.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(aside, where, options)
        except Exception as e:
            fs.delete(aside, False)
            raise ConflictError(f"version {version} is taken") from e

    def _open(self, names: list[str]) -> list[DataFrame]:
        want: StructType = _parse_datatype_string(self.ddl)
        tables = [self.spark.read.parquet(f"{self.path}/data/{n}") for n in names]
        for table in tables:
            if [(f.name, f.dataType) for f in table.schema] != [(f.name, f.dataType) for f in want]:
                raise CorruptError("a layer has another schema")
        return tables

    def _entry(self, version: int) -> dict:
        entry = self._manifest(version)
        if entry["format"] != FORMAT_VERSION or entry["state"] != self.state:
            raise CorruptError("format or state differs from the store's")
        return entry

    def _layers(self) -> list[DataFrame]:
        version = self.head()
        if not version:
            raise NotFoundError("the store is empty")
        return self._open(self._entry(version)["layers"])

    def _write(self, layer: DataFrame) -> str:
        name = uuid.uuid4().hex
        kinds = fields_of(self.ddl)
        layer.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()]).write.parquet(f"{self.path}/data/{name}")
        return name

    def _add(self, layer: DataFrame, check, patience: float = 10.0) -> None:
        """Another commit may come first: check and claim again, for ``patience``
        seconds."""
        name, until = None, time.monotonic() + patience
        while True:
            version = self.head()
            names = self._entry(version)["layers"] if version else []
            check(self._open(names))
            name = name or self._write(layer)
            try:
                self._claim(version + 1, {"format": FORMAT_VERSION, "state": self.state, "layers": [*names, name]})
                break
            except ConflictError:
                if time.monotonic() > until:
                    raise
                time.sleep(0.025)
        if len(names) >= LAYERS:
            self.compact()

    def compact(self) -> None:
        """Write all layers as one; a commit that comes first wins."""
        version = self.head()
        one = self._write(self._layer(newest(self._layers())))
        try:
            self._claim(version + 1, {"format": FORMAT_VERSION, "state": self.state, "layers": [one]})
        except ConflictError:
            self._drop([one])

    def _drop(self, names: list[str]) -> None:
        for n in names:
            fs, where = self._fs(f"{self.path}/data/{n}")
            fs.delete(where, True)

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests but the newest ``keep``, and the layers that only
        older ones name. Readers of those versions must be done."""
        versions = self._versions()
        kept, old = versions[-keep:], versions[:-keep]
        named = {n for v in kept for n in self._manifest(v)["layers"]}
        gone = {n for v in old for n in self._manifest(v)["layers"]} - named
        for v in old:
            fs, where = self._fs(f"{self.path}/manifest/{v:012d}.json")
            fs.delete(where, False)
        self._drop(sorted(gone))


def encode(state) -> object:
    """The state codec: JSON text that keeps nulls."""
    return F.to_json(state, {"ignoreNullFields": "false"})


def decode(text, ddl: str) -> object:
    """Back from JSON; text that does not parse is null."""
    return F.from_json(text, ddl, {"mode": "PERMISSIVE"})


def corrupt(rows: DataFrame, text: str, ddl: str) -> DataFrame:
    """Rows whose state text (a struct's) is there and does not decode."""
    probe = F.from_json(F.col(text), f"{ddl[:-1]},_bad:string>", {"columnNameOfCorruptRecord": "_bad"})
    return rows.where(F.col(text).isNotNull()).withColumn("_probe", probe).where(F.col("_probe").isNull() | F.col("_probe._bad").isNotNull()).drop("_probe")
