"""A table with one row for each key, changed in place: only the buckets that a change touches are written anew.

Rows lie in buckets by the hash of their key. A change reads the touched buckets, writes their new state
into a folder of its own, and then puts a new manifest beside the old ones, which says for each bucket
in what folder it is. Until then readers see the state before, so a run that is cut off changes nothing, and one
that is repeated gives the same rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from foliospark.operators import incremental
from foliospark.storage import delete


class Conflict(RuntimeError):
    """Another run has put its manifest first."""


class KeyedTable:
    """The table below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: StructType | str, keys: Sequence[str], buckets: int = 64) -> KeyedTable:
        """An empty table. ``buckets``: so many that one of them fits a task."""
        table = cls(spark, root)
        wanted = spark.createDataFrame([], schema).schema
        table._commit(0, {"keys": list(keys), "buckets": buckets, "schema": wanted.json(), "places": {}})
        return table

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def versions(self) -> list[int]:
        where = self._path("manifests")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(where) if f.getPath().getName().isdigit()) if self._fs.exists(where) else []

    def state(self, version: int | None = None) -> dict:
        """The manifest of a version, of the last one by default."""
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no table at {self.root}")
        version = known[-1] if version is None else version
        stream = self._fs.open(self._path("manifests", str(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"version": version}
        finally:
            stream.close()

    def _commit(self, version: int, state: dict) -> None:
        """Puts the manifest of a version, if there is none: a file that is complete is renamed, never over another."""
        jvm = self.spark._jvm
        part, whole = self._path("manifests", f"_{uuid.uuid4().hex}"), self._path("manifests", str(version))
        stream = self._fs.create(part)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri())
        never_over = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(part, whole, never_over)
        except Exception as error:
            self._fs.delete(part, False)
            if self._fs.exists(whole):
                raise Conflict(f"version {version} of {self.root} is there already") from error
            raise

    def read(self, buckets: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, of some or all buckets."""
        state = self.state(version)
        schema = StructType.fromJson(json.loads(state["schema"]))
        by_folder: dict[str, list[int]] = {}
        for bucket, folder in state["places"].items():
            if buckets is None or int(bucket) in buckets:
                by_folder.setdefault(folder, []).append(int(bucket))
        whole = StructType([*schema.fields, StructField("bucket", IntegerType())])
        parts = [self.spark.read.schema(whole).parquet(f"{self.root}/data/{f}").where(F.col("bucket").isin(own)).drop("bucket") for f, own in sorted(by_folder.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def _change(self, rows: DataFrame, merged) -> int:
        """Writes what ``merged(old rows of the touched buckets)`` gives, and returns the new version."""
        state = self.state()
        bucket = F.pmod(F.xxhash64(*state["keys"]), F.lit(state["buckets"])).cast("int")
        touched = sorted(r[0] for r in rows.select(bucket.alias("b")).where("b is not null").distinct().collect())
        if not touched:
            return state["version"]
        folder = uuid.uuid4().hex
        out = merged(self.read(touched, state["version"])).withColumn("bucket", bucket)
        out.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
        path = self._path("data", folder)
        filled = {int(f.getPath().getName().removeprefix("bucket=")) for f in self._fs.listStatus(path) if f.getPath().getName().startswith("bucket=")}
        places = {k: v for k, v in state["places"].items() if int(k) not in touched} | {str(k): folder for k in sorted(filled)}
        self._commit(state["version"] + 1, {k: state[k] for k in ("keys", "buckets", "schema")} | {"places": places})
        return state["version"] + 1

    def upsert(self, new: DataFrame, update: Sequence[str] | None = None, keep_old_if_null: bool = False, order: Sequence[str] | None = None) -> int:
        """``incremental.upsert`` into the touched buckets; columns that new lacks are null for new keys."""
        state = self.state()
        keys, names = state["keys"], StructType.fromJson(json.loads(state["schema"])).names
        held = incremental.one_row_a_key(new, keys, order, each_column=keep_old_if_null).select(*[c for c in names if c in new.columns])
        return self._change(held, lambda old: incremental.upsert(old, held, keys, update, keep_old_if_null))

    def replace(self, new: DataFrame, scope: Sequence[str], order: Sequence[str] | None = None) -> int:
        """Takes out all rows whose ``scope`` columns occur in new, then puts new; the whole table is touched where scope is not the key."""
        state = self.state()
        names = StructType.fromJson(json.loads(state["schema"])).names
        held = incremental.one_row_a_key(new.select(*names), state["keys"], order)
        gone = self.read().join(held.select(*scope).distinct(), list(scope), "left_semi").select(*names)
        return self._change(gone.unionByName(held), lambda old: old.join(held.select(*scope).distinct(), list(scope), "left_anti").select(*names).unionByName(held))

    def delete(self, keys: DataFrame) -> int:
        """Takes out the rows of these keys."""
        own = self.state()["keys"]
        gone = keys.select(*own).distinct()
        return self._change(gone, lambda old: old.join(gone, own, "left_anti"))

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the last ``keep`` versions and the folders that none of those names."""
        known = self.versions()
        kept = {f for v in known[-keep:] for f in self.state(v)["places"].values()}
        for v in known[:-keep]:
            self._fs.delete(self._path("manifests", str(v)), False)
        where = self._path("data")
        for f in self._fs.listStatus(where) if self._fs.exists(where) else []:
            if f.getPath().getName() not in kept:
                delete(self.spark, f.getPath().toString())
