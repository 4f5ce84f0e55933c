"""Tables kept in key buckets: a merge rewrites the buckets that its batch touches and no others (L2).

    <path>/data/version=<n>/bucket=<b>/   rows of one bucket as of merge n
    <path>/manifest/<n>.json              which version of each bucket is valid, and the columns

The newest manifest counts. It is written beside its place and renamed into it after
the data are complete, so a merge is seen whole or not at all; a merge that broke off
is done again over its own folder, and one whose number the manifest has reached
changes nothing. Buckets that neither the newest manifest nor the one before it names
are removed, so a reader that began before a merge can finish.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class BucketTable:
    """A keyed table at ``path``; ``buckets`` is fixed when it is first written."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    # ------------------------------------------------------------------ files
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        at = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._fs().listStatus(at)) if self._fs().exists(at) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._names("manifest") if n.endswith(".json")]

    def manifest(self, back: int = 0) -> dict | None:
        """The newest manifest, or the one ``back`` merges before."""
        names = self._manifests()
        if len(names) <= back:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{names[-1 - back]}", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        fs, name = self._fs(), f"{manifest['version']:012d}.json"
        part, place = self._path("manifest", f"_{name}"), self._path("manifest", name)
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(part, place):
            raise RuntimeError(f"could not commit {place}")

    def _remove_old(self) -> None:
        valid = {(v, b) for m in (self.manifest(), self.manifest(1)) if m for b, v in m["buckets"].items()}
        for folder in self._names("data"):
            version = int(folder.partition("=")[2])
            own = [b for b in self._names("data", folder) if b.startswith(f"{BUCKET}=")]
            gone = [b for b in own if (version, b.partition("=")[2]) not in valid]
            for b in gone:
                self._fs().delete(self._path("data", folder, b), True)
            if len(gone) == len(own):
                self._fs().delete(self._path("data", folder), True)
        for name in self._manifests()[:-2]:
            self._fs().delete(self._path("manifest", name), True)

    # ------------------------------------------------------------------ table
    def read(self, only: Sequence[int] | None = None) -> DataFrame | None:
        """The table, or its buckets ``only``; None before the first merge."""
        m = self.manifest()
        if m is None:
            return None
        schema = StructType.fromJson(m["schema"])
        wanted = m["buckets"] if only is None else {b: v for b, v in m["buckets"].items() if int(b) in set(only)}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/version={v}/{BUCKET}={b}" for b, v in wanted.items()))

    def merge(self, batch: DataFrame, version: int, combine: Callable[[DataFrame | None, DataFrame], DataFrame]) -> bool:
        """Merge number ``version``: the touched buckets become ``combine(their rows or None, batch)``, which keeps the key
        columns. False, and nothing changed, if that merge is in the table already."""
        m = self.manifest() or {"version": -1, "buckets": {}, "n": self.buckets}
        if version <= m["version"]:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(m["n"])).cast("int")
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]   # at most the number of buckets
        schema, valid = m.get("schema"), {b: v for b, v in m["buckets"].items() if int(b) not in touched}
        if touched:
            new = combine(self.read(touched) if m["version"] >= 0 else None, batch)
            schema = new.schema.jsonValue()
            (new.withColumn(BUCKET, bucket).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET)
             .parquet(f"{self.path}/data/version={version}"))
            valid |= {n.partition("=")[2]: version for n in self._names("data", f"version={version}") if n.startswith(f"{BUCKET}=")}
        self._commit({"version": version, "n": m["n"], "schema": schema or batch.schema.jsonValue(), "buckets": valid})
        self._remove_old()
        return True

    def batches(self, combine: Callable[[DataFrame | None, DataFrame], DataFrame]):
        """``foreachBatch`` function that merges every micro-batch."""
        def run(batch: DataFrame, batch_id: int) -> None:
            batch.persist()          # read for the touched buckets and for the merge
            try:
                self.merge(batch, batch_id, combine)
            finally:
                batch.unpersist()
        return run
