"""Inserts, updates and deletes as new versions of a type's tables.

A change builds the next tables as plans over the ones before and puts them in place at its end, so that a change that
fails leaves nothing behind. An update is one projection of the table; rewrites are columns of the new rows, beside the
old ones; triggers insert rows made from the changed ones. Ids of rows that triggers or tables insert are hashes of the
change, which has a random id of its own, and of what caused them: evaluating a plan again gives the same rows, and no
other change, session or caller gives the same ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import semantic
from weftline.functions.predicates import Predicate
from weftline.functions.stdlib import call as std_call
from weftline.operators import policies
from weftline.plans.catalog import Link, Property, Rewrite, new, old, qualified
from weftline.plans.elements import Call, Select
from weftline.sources.store import LinkTable, new_id


@dataclass(frozen=True)
class Result:
    kind: str
    changes: int
    id: str | None = None


@dataclass(frozen=True)
class Insert:
    """An insert as a value of a link of another insert."""

    type: str
    values: Mapping[str, Any]


@dataclass(frozen=True)
class Conflict:
    """What to do when an object with the same ``on`` (by default name, else title) is there: nothing, or set values."""

    on: str | None = None
    update: Mapping[str, Any] | None = None
    select: Select | None = None


class Changer:
    """Applies one statement to a copy of the graph's store; ``graph.store`` is replaced when all of it has worked."""

    def __init__(self, graph: Any):
        self.graph, self.store, self.catalog, self.context = graph, graph.store.copy(), graph.catalog, graph.context
        policies.may_modify(self.context)
        self.shaper = graph.shaper(self.store, seen=False)
        self.shaper.changing = True
        self.version, self.change = graph.version + 1, new_id()

    def commit(self) -> None:
        self.graph.store, self.graph.version = self.store, self.version
        self.graph.saved()

    # insert

    def insert(self, type_name: str, values: Mapping[str, Any], conflict: Conflict | None = None) -> Result:
        name = self.catalog.resolve(type_name, self.graph.module)
        if conflict and (done := self.on_conflict(name, self.checked(name, values)[0], conflict)):
            return done
        return self.insert_all(type_name, [values])

    def insert_all(self, type_name: str, many: Iterable[Mapping[str, Any]]) -> Result:
        """Objects of one type, in one append to its table and to each of its link tables."""
        name = self.catalog.resolve(type_name, self.graph.module)
        rows, id = [], None
        tables: dict[str, list[DataFrame]] = {}
        for values in many:
            scalars, links = self.checked(name, values)
            id, inline = new_id(), {}
            for link, value in links.items():
                targets = self.targets(self.catalog.links(name)[link], value)
                if isinstance(self.store.managed(name).links[link], LinkTable):
                    tables.setdefault(link, []).append(targets.select(F.lit(id).alias("source"), "target"))
                else:
                    first = targets.first()
                    inline[f"{link}_id"] = first and first[0]
            rows.append({"id": id} | scalars | inline)
        before = self.store.managed(name).table
        kinds = {f.name: f.dataType.simpleString() for f in before.schema}
        made = self.graph.spark.createDataFrame([tuple(r.get(c) for c in kinds) for r in rows], ", ".join(f"`{c}` {k}" for c, k in kinds.items()))
        made = self.rewritten(name, made, "insert")
        policies.check(self.catalog, self.shaper, self.context, name, "insert", self.framed(made, name))
        self.store.replace_table(name, before.unionByName(made.select(*before.columns)))
        for link, links in tables.items():
            self.store.add_links(name, link, reduce(DataFrame.unionByName, links).distinct())
        self.fire(name, "insert", made.select("id", F.lit(None).alias("_old"), F.struct(*before.columns).alias("_new")))
        return Result("insert", len(rows), id)

    def checked(self, name: str, values: Mapping[str, Any]) -> tuple[dict[str, Any], dict[str, Any]]:
        """The values of properties and of links, by name, after all checks that need no data."""
        if self.catalog.types[name].abstract:
            raise semantic(f"cannot insert into abstract object type '{name}'")
        members = self.catalog.members(name)
        scalars: dict[str, Any] = {}
        links: dict[str, Any] = {}
        for key, value in values.items():
            if key == "id":
                raise semantic("property 'id' cannot be assigned")
            if key.endswith("_id") and key not in members and isinstance(members.get(key[:-3]), Link):
                links[key[:-3]] = value
            elif isinstance(m := members.get(key), Link):
                links[key] = value
            elif isinstance(m, Property):
                for v in value if m.multi and value is not None else [value]:
                    self.shaper.check_value(m, v)
                scalars[key] = list(value) if m.multi and value is not None else float(value) if self.catalog.spark_type(m.type) == "double" and value is not None else value
            else:
                raise semantic(f"'{name}' has no property or link '{key}'")
        rewritten = {r.name for r in self.catalog.collected(name, "rewrites") if "insert" in r.events}
        for m in members.values():
            if getattr(m, "required", False) and (scalars | links).get(m.name) is None and m.name not in rewritten:
                raise semantic(f"missing value for required '{m.name}' of '{name}'")
        return scalars, links

    def targets(self, link: Link, value: Any) -> DataFrame:
        """The ids (``target``) that a link's value stands for, each of an object of the target type.

        The ids of a query are never brought to the driver; ids that are given are looked up together.
        """
        target = self.catalog.resolve(link.target, self.graph.module)
        given: list[str] = []
        queries: list[DataFrame] = []

        def take(v: Any) -> None:
            if isinstance(v, Insert):
                given.append(self.insert(v.type, v.values).id)
            elif isinstance(v, Select):
                found = self.graph.shaper(self.store).select(Select(v.type, ("id",), v.where, v.order_by or "id", v.desc, v.offset, v.limit))
                queries.append(found.toDF("target"))
            elif isinstance(v, (list, tuple, set)):
                for x in v:
                    take(x)
            elif v is not None:
                given.append(v)

        take(value)
        missing = set(given) - self.store.existing(given, target)
        for id in (v for v in given if v in missing):
            elsewhere = next((n for n in self.catalog.types if not self.catalog.types[n].abstract and self.store.existing([id], n)), None)
            if elsewhere:
                raise semantic(f"link '{link.name}' expected '{target}', got '{elsewhere}'")
            raise semantic(f"'{id}' does not reference an existing object of '{target}'")
        literal = self.graph.spark.createDataFrame([(v,) for v in given], "target string")
        return reduce(DataFrame.unionByName, [literal, *queries])

    def on_conflict(self, name: str, scalars: Mapping[str, Any], conflict: Conflict) -> Result | None:
        on = conflict.on or next((f for f in ("name", "title") if f in self.catalog.properties(name)), None)
        if on is None or on not in scalars:
            raise semantic(f"'{name}' has no value to find a conflict on")
        same = F.col(on) == F.lit(scalars[on])
        there = self.store.managed(name).table.where(same)
        if there.isEmpty():
            return None
        if conflict.update is None:
            return Result("insert", 0)
        first = there.agg(F.min("id")).first()[0]
        return self.update_where(name, F.col("id") == first, conflict.update, "insert")

    # update and delete

    def update(self, type_name: str, where: Predicate | None, values: Mapping[str, Any]) -> Result:
        name = self.catalog.resolve(type_name, self.graph.module)
        return self.update_where(name, self.matches(name, where), values, "update")

    def matches(self, name: str, where: Predicate | None) -> Column:
        return F.lit(True) if where is None else F.coalesce(self.shaper.condition(where, name, [name]), F.lit(False))

    def framed(self, table: DataFrame, name: str) -> DataFrame:
        return table.withColumns({"_type": F.lit(name), "_k": F.col("id"), "_id": F.col("id")})

    def update_where(self, name: str, hit: Column, values: Mapping[str, Any], kind: str) -> Result:
        for key, value in values.items():
            self.shaper.check_value(self.shaper.member(name, key), value)
        table = self.store.managed(name).table
        kinds = {f.name: f.dataType for f in table.schema}
        framed = self.framed(table, name)
        both = framed.withColumns({"_hit": hit, "_old": F.struct(*table.columns)})
        both = self.rewritten(name, both.withColumns({k: F.lit(v).cast(kinds[k]) for k, v in values.items()}), "update", True)
        touched = {*values, *(r.name for r in self.rewrites(name, "update"))}
        after = both.where("_hit")
        policies.check(self.catalog, self.shaper, self.context, name, "update_read", framed.where(hit))
        policies.check(self.catalog, self.shaper, self.context, name, "update_write", after)
        self.store.updated(name, both.select(*[F.when(F.col("_hit"), F.col(c)).otherwise(F.col("_old")[c]).alias(c) if c in touched else F.col(c) for c in table.columns]))
        self.fire(name, "update", after.select("id", "_old", F.struct(*table.columns).alias("_new")))
        return Result(kind, framed.where(hit).count())

    def delete(self, type_name: str, where: Predicate | None) -> Result:
        name = self.catalog.resolve(type_name, self.graph.module)
        table = self.store.managed(name).table
        framed = self.framed(table, name).withColumn("_hit", self.matches(name, where))
        gone = framed.where("_hit").drop("_hit")
        policies.check(self.catalog, self.shaper, self.context, name, "delete", gone)
        self.store.replace_table(name, framed.where("not _hit").select(*table.columns))
        self.fire(name, "delete", gone.select("id", F.struct(*table.columns).alias("_old"), F.lit(None).alias("_new")))
        return Result("delete", gone.count())

    # behaviours

    def rewrites(self, name: str, event: str) -> list[Rewrite]:
        return [r for r in self.catalog.collected(name, "rewrites") if event in r.events]

    def rewritten(self, name: str, rows: DataFrame, event: str, paired: bool = False) -> DataFrame:
        """New rows after an event's rewrites; ``paired`` rows have what they were before in ``_old``."""
        kinds = {f.name: f.dataType for f in rows.schema}

        def value(v: Any) -> Column:
            if isinstance(v, new):
                return F.col(v.name)
            if isinstance(v, old):
                return F.col("_old")[v.name] if paired else F.lit(None)
            if isinstance(v, Call):
                return std_call(v.function, []).col
            return F.lit(v)

        changed = {r.name: value(r.value).cast(kinds[r.name]) for r in self.rewrites(name, event)}
        return rows.withColumns(changed) if changed else rows

    def fire(self, name: str, event: str, rows: DataFrame) -> None:
        """Insert the rows of all triggers of an event, from rows (id, _old, _new): what objects were and are, or null."""
        for t in self.catalog.collected(name, "triggers"):
            if t.event != event:
                continue
            at = {f.name: f.dataType.typeName() != "void" for f in rows.schema}
            hit = rows
            if t.when_changed and at["_old"] and at["_new"]:
                hit = rows.where(~F.col("_old")[t.when_changed].eqNullSafe(F.col("_new")[t.when_changed]))
            target = self.catalog.resolve(t.target, self.graph.module)
            table = self.store.managed(target).table
            kinds = {f.name: f.dataType for f in table.schema}

            def value(v: Any) -> Column:
                side = "_new" if isinstance(v, new) else "_old" if isinstance(v, old) else None
                return F.lit(v) if side is None else F.col(side)[v.name] if at[side] else F.lit(None)

            made = {"id": F.md5(F.concat_ws(":", F.lit(t.name), F.lit(self.change), F.col("id")))} | {k: value(v) for k, v in t.values.items()}
            if unknown := set(made) - set(kinds):
                raise semantic(f"trigger '{t.name}' sets {sorted(unknown)}, which '{target}' does not have")
            fresh = hit.select(*[made.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
            self.store.replace_table(target, table.unionByName(self.rewritten(target, fresh, "insert")))


def combinations(values: Iterable[Iterable[str]]) -> list[str]:
    """Every way to join one text of each set, in order."""
    return ["".join(v) for v in product(*values)]


def for_each(graph: Any, values: Iterable[Any], insert: Callable[[Any], tuple[str, Mapping[str, Any]]]) -> Result:
    """An insert for each value, all in one change, with one append to the table of each type."""
    change = Changer(graph)
    by_type: dict[str, list[Mapping[str, Any]]] = {}
    for v in values:
        name, row = insert(v)
        by_type.setdefault(name, []).append(row)
    done = [change.insert_all(name, rows) for name, rows in by_type.items()]
    change.commit()
    return Result("for", sum(r.changes for r in done))


def insert_rows(graph: Any, type_name: str, rows: DataFrame) -> None:
    """Append many rows at once: columns are properties and ``<link>_id``; ids are hashes of the change and a row's place.

    The rows are part of the type's plan from now on: write them first if their order is not the same each time.
    """
    change = Changer(graph)
    name = change.catalog.resolve(type_name, graph.module)
    table = change.store.managed(name).table
    if unknown := set(rows.columns) - set(table.columns):
        raise semantic(f"'{qualified(name)}' has no {sorted(unknown)}")
    id = F.md5(F.concat_ws(":", F.lit(name), F.lit(change.change), F.monotonically_increasing_id().cast("string")))
    made = rows.withColumn("id", id) if "id" not in rows.columns else rows
    made = made.select(*[(F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema])
    made = change.rewritten(name, made, "insert")
    policies.check(change.catalog, change.shaper, change.context, name, "insert", change.framed(made, name))
    change.store.replace_table(name, table.unionByName(made))
    change.fire(name, "insert", made.select("id", F.lit(None).alias("_old"), F.struct(*table.columns).alias("_new")))
    change.commit()
