"""A graph's tables as versions in a folder that the whole cluster reaches.

A version is a small document that names a Parquet table for each type and link table. What a change leaves alone keeps
its table; what it touches is written anew, and the version is committed by one rename, which fails if another session
has committed that version meanwhile. Tables of old versions stay until they are vacuumed.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftline.sources.store import Binding, LinkTable, Store


def rename_once(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder, which fails if the target is there: of writers of one version, one succeeds."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    path, none = hadoop.Path(source), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    hadoop.FileContext.getFileContext(path.toUri(), conf).rename(path, hadoop.Path(target), none)


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        #: Tables that are written already, by the DataFrames that stand for them.
        self._written: dict[int, tuple[DataFrame, dict[str, Any]]] = {}
        self._at = 0

    def _path(self, name: str) -> Any:
        return self._hadoop.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        folder = self._path("versions")
        fs = folder.getFileSystem(self._conf)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())

    def _read(self, entry: dict[str, Any]) -> DataFrame:
        table = self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(f"{self.root}/{entry['path']}")
        self._written[id(table)] = table, entry
        return table

    def _put(self, table: DataFrame) -> tuple[DataFrame, dict[str, Any]]:
        """The table as it is in the folder, written if it is not there yet."""
        if id(table) in self._written:
            return self._written[id(table)]
        path = f"tables/{uuid.uuid4().hex}"
        table.write.option("compression", "zstd").parquet(f"{self.root}/{path}")
        entry = {"path": path, "schema": table.schema.jsonValue()}
        return self._read(entry), entry

    def save(self, store: Store, version: int, history: list, batches: dict[str, int]) -> int:
        """Write the changed types of ``store`` and commit the next version; ``store`` then reads what was written."""
        types: dict[str, Any] = {}
        for name, b in list(store.bindings.items()):
            if b.native:
                continue
            table, entry = self._put(b.table)
            links, held = {}, {}
            for link, at in b.links.items():
                if isinstance(at, LinkTable):
                    rows, of = self._put(at.table)
                    links[link] = LinkTable(rows, at.source, at.target, at.props)
                    held[link] = {"table": of, "source": at.source, "target": at.target, "props": dict(at.props)}
                else:
                    links[link] = held[link] = at
            types[name] = {"table": entry, "key": b.key, "properties": dict(b.properties), "links": held}
            store.bindings[name] = Binding(table, b.key, b.properties, links, native=False)
        store.updates = {}
        said = json.dumps({"version": version, "history": history, "batches": batches, "types": types})
        draft = f"versions/draft-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.text(f"{self.root}/{draft}")
        rename_once(self.spark, f"{self.root}/{draft}", f"{self.root}/versions/v{self._at + 1}")
        self._at += 1
        return self._at

    def load(self, store: Store, version: int | None = None) -> tuple[int, list, dict[str, int]]:
        """Bind the types of a version (the latest) that the catalog has; the graph's version, history and batches."""
        self._at = version or self.versions()[-1]
        said = json.loads(self.spark.read.text(f"{self.root}/versions/v{self._at}", wholetext=True).first()[0])
        for name, held in said["types"].items():
            if name in store.catalog.types:
                links = {
                    link: at if isinstance(at, str) else LinkTable(self._read(at["table"]), at["source"], at["target"], at["props"])
                    for link, at in held["links"].items()
                }
                store.bindings[name] = Binding(self._read(held["table"]), held["key"], held["properties"], links, native=False)
        return said["version"], [tuple(h) for h in said["history"]], said["batches"]

    def vacuum(self) -> None:
        """Delete the tables that the version in use does not name."""
        said = self.spark.read.text(f"{self.root}/versions/v{self._at}", wholetext=True).first()[0]
        folder = self._path("tables")
        fs = folder.getFileSystem(self._conf)
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if f"tables/{status.getPath().getName()}" not in said:
                fs.delete(status.getPath(), True)
