"""Sharding by size-tiered compaction, in DataFrame functions only.

Arrivals are appended as small immutable shards, one for each input partition, without a shuffle. Compaction looks at
the manifest alone: shards of similar size form a tier, a tier with enough runs is merged into target-sized files, and
the next manifest version is committed by one atomic rename. Readers see one version; what it no longer names can be
vacuumed. A job that is lost on the way leaves files that no manifest names, and the version before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.scratch import shared_dir, spare_prefix
from weftline.sources.folder import rename_once

#: Bytes of a file that compaction aims at, runs of one tier that start a merge, and the size ratio of tiers.
TARGET_BYTES = 64 << 20
FAN_IN = 4
SMALLEST_BYTES = 64 << 10
#: Rows of one small shard, at most.
ARRIVAL_ROWS = 50_000
#: Shards that one commit merges, at most; what else is due waits for the next one.
DUE_SHARDS = 10_000

#: A shard's path in the manifest: below the root, wherever that is mounted.
_RELATIVE = ".*/(shards/[am]-[0-9a-f]{32}/.+)$"
_MANIFEST = "shard_id long, path string, rows long, bytes long, schema string"


class ShardStore:
    """Shards and manifest versions below ``root``, a folder that the whole cluster reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        fs = folder.getFileSystem(self._conf)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version (the latest): ``shard_id, path, rows, bytes``."""
        return self._entries(version).where("path is not null").drop("schema")

    def _entries(self, version: int | None) -> DataFrame:
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/v{version or known[-1]}")

    def commit(self, shards: DataFrame, schema: T.StructType, base: int) -> int:
        """Make ``shards`` version ``base`` + 1; fails if another writer has committed that version meanwhile."""
        head = self.spark.createDataFrame([(None, None, 0, 0, schema.json())], _MANIFEST)
        draft = f"manifests/draft-{uuid.uuid4().hex}"
        body = shards.select("shard_id", "path", "rows", "bytes", F.lit(None).cast("string").alias("schema"))
        head.unionByName(body).coalesce(1).write.parquet(f"{self.root}/{draft}")
        rename_once(self.spark, f"{self.root}/{draft}", f"{self.root}/manifests/v{base + 1}")
        return base + 1

    def append(self, arrivals: DataFrame) -> int:
        """Add the rows of ``arrivals`` as small shards; the new version."""
        known = self.versions()
        base = known[-1] if known else 0
        folder = f"shards/a-{uuid.uuid4().hex}"
        arrivals.write.option("compression", "zstd").option("maxRecordsPerFile", ARRIVAL_ROWS).parquet(f"{self.root}/{folder}")
        old = self.manifest() if known else self.spark.createDataFrame([], _MANIFEST).drop("schema")
        return self.commit(self._with_new(old, folder, arrivals.schema), arrivals.schema, base)

    def _with_new(self, old: DataFrame, folder: str, schema: T.StructType) -> DataFrame:
        """``old`` and the files of ``folder``, which get higher shard ids."""
        written = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{folder}")
        meta = written.metadataColumn("_metadata")
        files = written.groupBy(F.regexp_extract(meta["file_path"], _RELATIVE, 1).alias("path"), meta["file_size"].alias("bytes")).agg(F.count("*").alias("rows"))
        last = old.agg(F.coalesce(F.max("shard_id"), F.lit(0))).first()[0]
        new = files.select((F.lit(last + 1) + F.monotonically_increasing_id()).alias("shard_id"), "path", "rows", "bytes")
        return old.select("shard_id", "path", "rows", "bytes").unionByName(new)

    def plan(self, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> DataFrame:
        """The merges of the next commit: ``path, bytes, merged``. Shards with one number ``merged`` go into one file.

        Shards of half the target or more are left alone. A tier's shards are packed in the order of their ids, so a
        file gets up to the target and part of one shard more. At most ``DUE_SHARDS`` shards are planned at a time.
        """
        tier = F.floor(F.log(float(fan_in), F.greatest(F.col("bytes"), F.lit(SMALLEST_BYTES)) / SMALLEST_BYTES))
        small = self.manifest().where(F.col("bytes") < target_bytes / 2).withColumn("tier", tier)
        tiers = small.groupBy("tier").agg(F.count("*").alias("runs")).where(F.col("runs") >= fan_in).select("tier")
        due = small.join(tiers, "tier").orderBy("tier", "shard_id").limit(DUE_SHARDS)
        before = F.sum("bytes").over(Window.partitionBy("tier").orderBy("shard_id")) - F.col("bytes")
        packed = due.withColumn("nth", F.floor(before / target_bytes))
        return packed.select("path", "bytes", (F.dense_rank().over(Window.orderBy("tier", "nth")) - 1).alias("merged"))

    def compact(self, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> bool:
        """Merge once what is due and commit the next version; False if nothing is due. Only shards that are due are read."""
        base = self.versions()[-1]
        plan = self.plan(target_bytes, fan_in).collect()  # at most DUE_SHARDS rows
        if not plan:
            return False
        schema = self.schema()
        p = spare_prefix(schema.names)
        path, to = f"{p}path", f"{p}merged"
        due = self.spark.createDataFrame([(r["path"], r["merged"]) for r in plan], f"{path} string, {to} long")
        rows = self.read_files([r["path"] for r in plan], schema, path).join(F.broadcast(due), path).drop(path)
        folder = f"shards/m-{uuid.uuid4().hex}"
        merged = rows.repartitionById(len({r["merged"] for r in plan}), F.col(to).cast("int"))
        merged.write.option("compression", "zstd").partitionBy(to).parquet(f"{self.root}/{folder}")
        kept = self.manifest().join(due.select(F.col(path).alias("path")), "path", "left_anti")
        self.commit(self._with_new(kept, folder, schema), schema, base)
        return True

    def read_files(self, paths: list[str], schema: T.StructType, path: str) -> DataFrame:
        """The rows of these files or folders below the root, with their file's path in the column ``path``."""
        found = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f"{self.root}/{f}" for f in paths])
        return found.withColumn(path, F.regexp_extract(found.metadataColumn("_metadata")["file_path"], _RELATIVE, 1))

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self._entries(None).where("path is null").first()["schema"]))

    def read(self, version: int | None = None, path: str | None = None, shard_id: str | None = None) -> DataFrame:
        """The rows of a version; columns with their shard's path or id are added under the names given."""
        shards, schema = self.manifest(version), self.schema()
        folders = [r[0] for r in shards.select(F.substring_index("path", "/", 2)).distinct().collect()]
        prefix = spare_prefix([*schema.names, path or "", shard_id or ""])
        named = shards.select(F.col("path").alias(f"{prefix}path"), F.col("shard_id").alias(f"{prefix}id"))
        if folders:
            rows = self.read_files(folders, schema, f"{prefix}path")
        else:
            rows = self.spark.createDataFrame([], schema).withColumn(f"{prefix}path", F.lit(""))
        added = [F.col(prefix + held).alias(name) for held, name in (("path", path), ("id", shard_id)) if name]
        return rows.join(named, f"{prefix}path").select(*schema.names, *added)

    def vacuum(self) -> None:
        """Delete the folders of shards that the latest version doesn't name."""
        named = {r[0] for r in self.manifest().select(F.split_part("path", F.lit("/"), F.lit(2))).distinct().collect()}
        folder = self._path("shards")
        fs = folder.getFileSystem(self._conf)
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if status.getPath().getName() not in named:
                fs.delete(status.getPath(), True)


def shard(docs: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> ShardStore:
    """Append ``docs`` to the store at ``root`` (a new one in the shared folder), compact until nothing is due, vacuum.

    Every row is in exactly one shard, with its columns as they are: nulls, repeated rows, texts of any length and
    columns of any name are kept. An empty table gives a version without shards or with empty ones.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    store.append(docs)
    while store.compact(target_bytes, fan_in):
        pass
    store.vacuum()
    return store


def shard_report(docs: DataFrame, *keep: str) -> DataFrame:
    """Every row's ``keep`` columns with its shard, that shard's rows and bytes, and the manifest's version.

    Columns named like the four that are added are left out.
    """
    added = ("shard_id", "shard_rows", "shard_bytes", "version")
    keep = [c for c in keep if c.lower() not in added]
    store = shard(docs)
    p = spare_prefix(keep)
    shards = store.manifest().select(F.col("shard_id").alias(f"{p}shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    rows = store.read(shard_id=f"{p}shard").select(*keep, f"{p}shard").join(shards, f"{p}shard")
    return rows.select(*keep, F.col(f"{p}shard").alias("shard_id"), "shard_rows", "shard_bytes", F.lit(store.versions()[-1]).alias("version"))
