"""A table that is changed by key without being rewritten: base files by bucket, delta files, and a manifest that is swapped whole.

A batch of changes writes its own rows only.  Readers merge: of a key the
change of the greatest position counts.  ``compact`` rewrites the buckets that
deltas have touched, and the others stay as they are.  A manifest names every
file of one version; it is written beside its place and renamed, so a reader
sees one version or the next, and a batch that is applied again changes
nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from quarrystone.operators.tables import delete_dir

#: Deltas after which a batch compacts the table first.
MOST_DELTAS = 8


@dataclass(frozen=True)
class MergeTable:
    """Rows of one ``key``, changed by rows of ``op`` (upsert or delete), the key, ``position`` and other columns."""

    spark: SparkSession
    folder: str
    key: str
    position: str
    buckets: int = 16

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, store = self._path("manifests")
        return sorted(int(x.getPath().getName()) for x in store.listStatus(path) if x.getPath().getName().isdigit()) if store.exists(path) else []

    def manifest(self) -> dict:
        """The newest version: its number, the last batch, each bucket's base folder, the deltas with their buckets, and the schema."""
        known = self.versions()
        if not known:
            return {"version": 0, "batch": -1, "base": {}, "deltas": [], "schema": None}
        path, store = self._path(f"manifests/{known[-1]}")
        stream = store.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap(self, manifest: dict) -> None:
        made, store = self._path(f"manifests/.{manifest['version']}.new")
        out = store.create(made, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        place, _ = self._path(f"manifests/{manifest['version']}")
        if store.exists(place) or not store.rename(made, place):
            raise RuntimeError(f"another writer has made version {manifest['version']}")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, name: str) -> list[int]:
        """Write rows under ``name``, a folder a bucket; gives the buckets that have rows."""
        self._bucketed(rows).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}")
        path, store = self._path(name)
        return sorted(int(x.getPath().getName().removeprefix("bucket=")) for x in store.listStatus(path) if x.getPath().getName().startswith("bucket="))

    def apply(self, batch: DataFrame, number: int) -> None:
        """Add a batch of changes; a number that was applied before changes nothing.  Records without a key are left out."""
        now = self.manifest()
        if number <= now["batch"]:
            return
        if len(now["deltas"]) >= MOST_DELTAS:
            self.compact()
            now = self.manifest()
        own = batch.where(F.col(self.key).isNotNull())
        last = own.groupBy(self.key).agg(F.max_by(F.struct(*batch.columns), self.position).alias("r")).select("r.*")
        name = f"delta-{number}-{now['version'] + 1}"
        buckets = self._write(last, name)
        deltas = now["deltas"] + [{"name": name, "buckets": buckets}] if buckets else now["deltas"]
        self._swap(now | {"version": now["version"] + 1, "batch": number, "deltas": deltas, "schema": batch.schema.json()})

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows of buckets that no delta touches, the last change of each key of the others, deletes too)."""
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        touched = {b for d in manifest["deltas"] for b in d["buckets"]}
        empty = self.spark.createDataFrame([], schema)

        def read(paths: list[str]) -> DataFrame:
            return self.spark.read.schema(schema).parquet(*paths) if paths else empty

        quiet = read([f"{self.folder}/{name}/bucket={b}" for b, name in manifest["base"].items() if int(b) not in touched])
        changed = [f"{self.folder}/{name}/bucket={b}" for b, name in manifest["base"].items() if int(b) in touched] + [f"{self.folder}/{d['name']}/bucket={b}" for d in manifest["deltas"] for b in d["buckets"]]
        last = read(changed).groupBy(self.key).agg(F.max_by(F.struct(*schema.names), self.position).alias("r")).select("r.*")
        return quiet, last

    def read(self) -> DataFrame:
        """The rows as of the newest version; deleted keys are not there."""
        manifest = self.manifest()
        if manifest["schema"] is None:
            raise FileNotFoundError(f"{self.folder} has no version")
        quiet, last = self._rows(manifest)
        return quiet.unionByName(last).where("op <> 'delete'").drop("op")

    def compact(self) -> None:
        """Merge the deltas into new base files of the buckets that they touch; a delete stays as a mark, so that later records of old changes do not bring a key back."""
        now = self.manifest()
        if not now["deltas"]:
            return
        _, last = self._rows(now)
        name = f"base-{now['version'] + 1}"
        buckets = self._write(last, name)
        self._swap(now | {"version": now["version"] + 1, "base": now["base"] | {str(b): name for b in buckets}, "deltas": []})

    def clean(self) -> None:
        """Remove the files that the newest version does not name; not while older versions are read."""
        now = self.manifest()
        kept = set(now["base"].values()) | {d["name"] for d in now["deltas"]} | {"manifests"}
        path, store = self._path("")
        for x in store.listStatus(path):
            name = x.getPath().getName()
            if name not in kept and name.startswith(("base-", "delta-")):
                delete_dir(self.spark, f"{self.folder}/{name}")

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Apply a stream of changes, a micro-batch a delta."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
