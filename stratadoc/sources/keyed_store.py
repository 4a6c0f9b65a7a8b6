"""A keyed table whose batches look at stored rows of their own buckets only.

Rows are filed by a hash of their key into a fixed number of buckets; a batch writes its own folder, cut by
bucket. Beside it stands a Bloom filter per bucket, as bitmaps that Spark aggregates. A batch becomes visible by
one small manifest file, put in place by a rename; a batch that has one is not written again. What a lookup
reads are the bucket folders whose filter knows one of its keys.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from stratadoc.session import durable

BUCKETS = 64
PROBES = 4
BITMAP_BITS = 32_768
#: Bits of a filter per key that is expected in a bucket of a batch.
BITS_PER_KEY = 12


@dataclass
class KeyedStore:
    """``key`` columns identify a row; ``root`` is a folder that all executors reach."""

    spark: SparkSession
    root: str
    key: tuple[str, ...]
    buckets: int = BUCKETS

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifests(self, before: int | None = None) -> list[dict]:
        """``batch_id, bitmaps, sizes, schema`` of the visible batches, in order."""
        path, store = self._files()
        folder = path(f"{self.root}/_manifest")
        if not store.exists(folder):
            return []
        found = []
        for file in store.listStatus(folder):
            if file.getPath().getName().endswith(".json"):
                source = store.open(file.getPath())
                found.append(json.loads(bytes(source.readAllBytes())))
                source.close()
        return sorted((m for m in found if before is None or m["batch_id"] < before), key=lambda m: m["batch_id"])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _probes(self, bitmaps: Column) -> Column:
        """Bitmap and bit of each probe of a key in a filter of so many bitmaps."""
        places = [F.pmod(F.xxhash64(*self.key, F.lit(s)), bitmaps * F.lit(BITMAP_BITS)) for s in range(1, PROBES + 1)]
        return F.array(*[F.struct(F.floor(p / BITMAP_BITS).cast("int").alias("number"), (p % BITMAP_BITS).alias("bit")) for p in places])

    def has(self, batch_id: int) -> bool:
        """Whether a batch is visible."""
        path, store = self._files()
        return bool(store.exists(path(f"{self.root}/_manifest/{batch_id}.json")))

    def append(self, rows: DataFrame, batch_id: int) -> bool:
        """Store rows as one batch; false if it is there already or has no rows."""
        if self.has(batch_id):
            return False
        path, store = self._files()
        mark = path(f"{self.root}/_manifest/{batch_id}.json")
        target = f"{self.root}/batch_id={batch_id}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        filed = self.spark.read.schema(rows.schema).parquet(target).select(*self.key, self._bucket())
        sizes = {r["bucket"]: r["count"] for r in filed.groupBy("bucket").count().collect()}
        if not sizes:
            return False
        bitmaps = max(1, -(-max(sizes.values()) * BITS_PER_KEY // BITMAP_BITS))
        probes = filed.select("bucket", F.explode(self._probes(F.lit(bitmaps))).alias("p"))
        filters = probes.groupBy("bucket", "p.number").agg(F.bitmap_construct_agg("p.bit").alias("bits"))
        filters.write.mode("overwrite").parquet(f"{self.root}/_filters/batch_id={batch_id}")
        manifest = {"batch_id": batch_id, "bitmaps": bitmaps, "sizes": sizes, "schema": rows.schema.jsonValue()}
        fresh = path(f"{self.root}/_manifest/.{uuid.uuid4().hex}")
        sink = store.create(fresh)
        sink.write(bytearray(json.dumps(manifest).encode()))
        sink.close()
        return bool(store.rename(fresh, mark))

    def folders_with(self, keys: DataFrame, before: int | None = None) -> list[str]:
        """Bucket folders whose filter knows one of ``keys``; at most one row a folder comes to the driver."""
        return self._folders_of(keys.select(*self.key).distinct(), before)

    def _folders_of(self, keys: DataFrame, before: int | None) -> list[str]:
        """The same for distinct keys."""
        manifests = self.manifests(before)
        folders = [(m["batch_id"], m["bitmaps"], int(b)) for m in manifests for b in m["sizes"]]
        if not folders:
            return []
        there = self.spark.createDataFrame(folders, "batch_id long, bitmaps int, bucket int")
        wanted = keys.select("*", self._bucket()).join(there, "bucket")
        wanted = wanted.select("batch_id", "bucket", F.xxhash64(*self.key).alias("id"), F.explode(self._probes(F.col("bitmaps"))).alias("p"))
        filters = self.spark.read.schema("bucket int, number int, bits binary, batch_id long").parquet(f"{self.root}/_filters")
        joined = wanted.select("batch_id", "bucket", "id", "p.number", "p.bit").join(filters, ["batch_id", "bucket", "number"])
        byte = "cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)"
        known = joined.where(F.expr(f"(shiftright({byte}, cast(bit % 8 as int)) & 1) = 1"))
        all_set = known.groupBy("batch_id", "bucket", "id").count().where(F.col("count") >= PROBES)
        hits = all_set.select("batch_id", "bucket").distinct().collect()
        return sorted(f"{self.root}/batch_id={r['batch_id']}/bucket={r['bucket']}" for r in hits)

    def _read(self, folders: list[str], manifest: dict) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"]).add("batch_id", "long")
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*folders)

    def rows(self) -> DataFrame | None:
        """All visible rows with their ``batch_id``; None if there are none."""
        manifests = self.manifests()
        return self._read([f"{self.root}/batch_id={m['batch_id']}" for m in manifests], manifests[-1]) if manifests else None

    def newest(self) -> DataFrame | None:
        """The newest row of each key."""
        rows = self.rows()
        if rows is None:
            return None
        last = rows.groupBy(*self.key).agg(F.max("batch_id").alias("batch_id"))
        return rows.join(last, [*self.key, "batch_id"], "left_semi").drop("batch_id")

    def known(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Those of the distinct ``keys`` that are stored, from the folders that may hold them alone."""
        if not self.manifests(before):
            return keys.select(*self.key).where(F.lit(False))
        wanted = durable(keys.select(*self.key).distinct())
        folders = self.folders_with(wanted, before)
        if not folders:
            return wanted.where(F.lit(False))
        stored = self._read(folders, self.manifests()[-1]).select(*self.key)
        return wanted.join(stored, list(self.key), "left_semi")

    def matching(self, keys: DataFrame) -> DataFrame | None:
        """All stored rows of the given keys, from the folders that may hold them; None if nothing is stored."""
        manifests = self.manifests()
        if not manifests:
            return None
        wanted = durable(keys.select(*self.key).distinct())
        folders = self.folders_with(wanted)
        if not folders:
            return self._read([f"{self.root}/batch_id={manifests[-1]['batch_id']}"], manifests[-1]).where(F.lit(False))
        return self._read(folders, manifests[-1]).join(wanted, list(self.key), "left_semi")

    def append_new(self, rows: DataFrame, batch_id: int) -> bool:
        """Store the rows whose key no earlier batch holds; of rows with one key any is stored."""
        if self.has(batch_id):
            return False
        rows = rows.dropDuplicates(list(self.key))
        if not self.manifests(batch_id):
            return self.append(rows, batch_id)
        rows = durable(rows)
        # Written and without copies, so the keys need no pass of their own.
        folders = self._folders_of(rows.select(*self.key), batch_id)
        if folders:
            stored = self._read(folders, self.manifests()[-1]).select(*self.key)
            rows = rows.join(stored, list(self.key), "left_anti").select(*rows.columns)
        return self.append(rows, batch_id)
