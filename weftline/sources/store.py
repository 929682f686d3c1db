"""Where the objects of concrete types are: registered tables with native keys, or tables that the engine changes.

A frame of a type has the columns ``_k`` (key), ``_id`` (text), every property, and ``_l_<link>`` for links stored with
the row. Ids of registered tables are ``Type:key``; joins use the keys, and ids are only rendered.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import semantic
from weftline.plans.catalog import Catalog, qualified


#: Updates of a type after which its table is written.
UPDATES_BEFORE_WRITING = 4


@dataclass(frozen=True)
class LinkTable:
    """A link stored apart from its objects: the columns of source and target keys, and of link properties."""

    table: DataFrame
    source: str
    target: str
    props: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Binding:
    """A registered table: its key column, expressions of properties and of single links' target keys, link tables."""

    table: DataFrame
    key: str
    properties: Mapping[str, Column | str]
    links: Mapping[str, Column | str | LinkTable] = field(default_factory=dict)
    native: bool = True


@dataclass(frozen=True)
class Pairs:
    """A link as rows: ``_sk, _sid`` (source), ``_tid`` and, if ``keyed``, ``_tk`` (target), and link properties as ``@name``."""

    rows: DataFrame
    keyed: bool


class Store:
    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog = spark, catalog
        self.bindings: dict[str, Binding] = {}
        #: Updates of each type since its table was last written.
        self.updates: dict[str, int] = {}

    def copy(self) -> Store:
        out = Store(self.spark, self.catalog)
        out.bindings, out.updates = dict(self.bindings), dict(self.updates)
        return out

    def register(self, name: str, binding: Binding) -> None:
        self.bindings[self.catalog.resolve(name)] = binding

    def register_parquet(self, name: str, path: str, key: str, properties: Mapping[str, Column | str], links: Mapping[str, Any] | None = None) -> None:
        self.register(name, Binding(self.spark.read.parquet(path), key, properties, links or {}))

    def binding(self, name: str) -> Binding:
        """The type's binding; a concrete type without one gets an empty table."""
        if name not in self.bindings:
            props = self.catalog.properties(name)
            columns = ["id string"] + [f"`{p.name}` {'array<%s>' % self.catalog.spark_type(p.type) if p.multi else self.catalog.spark_type(p.type)}" for p in props.values()]
            links: dict[str, Any] = {}
            for link in self.catalog.links(name).values():
                if link.multi or link.props:
                    kinds = "".join(f", `{p.name}` {self.catalog.spark_type(p.type)}" for p in link.props)
                    empty = self.spark.createDataFrame([], f"source string, target string{kinds}")
                    links[link.name] = LinkTable(empty, "source", "target", {p.name: p.name for p in link.props})
                else:
                    columns.append(f"`{link.name}_id` string")
                    links[link.name] = f"{link.name}_id"
            table = self.spark.createDataFrame([], ", ".join(columns))
            self.bindings[name] = Binding(table, "id", {p: p for p in props}, links, native=False)
        return self.bindings[name]

    @staticmethod
    def native_id(name: str, key: Column) -> Column:
        """The id of an object of a registered table from its native key; null for a null key."""
        return F.concat(F.lit(f"{name.rpartition('::')[2]}:"), key.cast("string"))

    @staticmethod
    def is_native_id(name: str, key: Column, id: Any) -> Column:
        """Whether a native key is that of the object with an id: a condition on the key itself, which scans can use."""
        prefix = f"{name.rpartition('::')[2]}:"
        if id is None:
            return F.lit(None).cast("boolean")
        return key == F.lit(id[len(prefix) :]) if isinstance(id, str) and id.startswith(prefix) else F.lit(False)

    def id_of(self, name: str, key: Column) -> Column:
        return self.native_id(name, key) if self.binding(name).native else key

    def is_id(self, name: str, key: Column, id: Any) -> Column:
        return self.is_native_id(name, key, id) if self.binding(name).native else key == F.lit(id)

    def frame(self, name: str) -> DataFrame:
        b = self.binding(name)
        key = F.col(b.key)
        props = {p: F.col(c) if isinstance(c, str) else c for p, c in b.properties.items()}
        links = {link: F.col(c) if isinstance(c, str) else c for link, c in b.links.items() if not isinstance(c, LinkTable)}
        missing = [
            F.lit(None).cast(f"array<{self.catalog.spark_type(p.type)}>" if p.multi else self.catalog.spark_type(p.type)).alias(p.name)
            for p in self.catalog.properties(name).values()
            if p.name not in props
        ]
        return b.table.select(
            F.lit(name).alias("_type"),
            key.alias("_k"),
            self.id_of(name, key).alias("_id"),
            *[c.alias(p) for p, c in props.items()],
            *missing,
            *[c.alias(f"_l_{link}") for link, c in links.items()],
        )

    def only_target(self, link: str, name: str) -> str | None:
        """The one concrete type that a link of a type can point to, if there is just one."""
        targets = self.catalog.concrete(self.catalog.resolve(self.catalog.links(name)[link].target))
        return targets[0] if len(targets) == 1 else None

    def inline(self, name: str, link: str) -> bool:
        return not isinstance(self.binding(name).links.get(link), LinkTable)

    def pairs(self, name: str, link: str) -> Pairs:
        """A link of one concrete type, however it is stored. A registered table holds native keys, a changed one ids."""
        b = self.binding(name)
        to = self.only_target(link, name)
        keyed = to is not None and b.native == self.binding(to).native
        held = b.links[link]
        if isinstance(held, LinkTable):
            source, target, table = F.col(held.source), F.col(held.target), held.table
            props = [F.col(c).alias(f"@{p}") for p, c in held.props.items()]
        else:
            source, target, table, props = F.col(b.key), F.col(held) if isinstance(held, str) else held, b.table, []
        ids = self.native_id(to, target) if b.native and to else target
        rows = table.select(source.alias("_sk"), self.id_of(name, source).alias("_sid"), target.alias("_tk"), ids.alias("_tid"), *props)
        return Pairs(rows.where("_tk is not null"), keyed)

    def managed(self, name: str) -> Binding:
        """The type's table in the form that changes work on: ids as keys, links as ids. Registered tables are copied lazily."""
        b = self.binding(name)
        if not b.native:
            return b
        frame = self.frame(name)
        links: dict[str, Any] = {}
        inline = []
        for link, held in b.links.items():
            p = self.pairs(name, link)
            if isinstance(held, LinkTable):
                props = {k: k for k in held.props}
                rows = p.rows.select(F.col("_sid").alias("source"), F.col("_tid").alias("target"), *[F.col(f"@{k}").alias(k) for k in props])
                links[link] = LinkTable(rows, "source", "target", props)
            else:
                to = self.only_target(link, name)
                c = F.col(f"_l_{link}")
                inline.append((self.native_id(to, c) if to else c).alias(f"{link}_id"))
                links[link] = f"{link}_id"
        table = frame.select(F.col("_id").alias("id"), *self.catalog.properties(name), *inline)
        return Binding(table, "id", {p: p for p in self.catalog.properties(name)}, links, native=False)

    def replace_table(self, name: str, table: DataFrame) -> None:
        b = self.managed(name)
        self.bindings[name] = Binding(table, "id", b.properties, b.links, native=False)

    def updated(self, name: str, table: DataFrame) -> None:
        """Replace a table by one whose columns look at those before more than once.

        A condition that is pushed through such columns doubles with each of them, so every few updates the table is
        written, and goes on from there.
        """
        self.updates[name] = self.updates.get(name, 0) + 1
        if self.updates[name] >= UPDATES_BEFORE_WRITING:
            path = f"{shared_dir(self.spark)}/tables/{uuid.uuid4().hex}"
            table.write.option("compression", "zstd").parquet(path)
            table, self.updates[name] = self.spark.read.schema(table.schema).parquet(path), 0
        self.replace_table(name, table)

    def add_links(self, name: str, link: str, rows: DataFrame) -> None:
        """Add rows (source, target) to a link table; a pair that is there already stays once."""
        b = self.managed(name)
        held = b.links[link]
        if not isinstance(held, LinkTable):
            raise semantic(f"link '{link}' of '{name}' is stored with its objects")
        fresh = rows.join(held.table, ["source", "target"], "left_anti")
        links = {**b.links, link: LinkTable(held.table.unionByName(fresh, allowMissingColumns=True), "source", "target", held.props)}
        self.bindings[name] = Binding(b.table, "id", b.properties, links, native=False)

    def existing(self, ids: list[str], target: str) -> set[str]:
        """Those of the ids that objects of a type or its sub types have: one look at each concrete type, by its keys."""
        found: set[str] = set()
        for name in self.catalog.concrete(qualified(target)) if ids else ():
            hit = reduce(lambda a, b: a | b, [self.is_id(name, F.col("_k"), id) for id in dict.fromkeys(ids)])
            found |= {r[0] for r in self.frame(name).where(hit).select("_id").distinct().collect()}
        return found


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, which only a local session may leave unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or "/tmp/checkpoints/weftline").rstrip("/")


def new_id() -> str:
    return uuid.uuid4().hex
