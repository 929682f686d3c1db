"""The engine: a catalog, a store and a caller's context behind one object."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import semantic
from weftline.functions.predicates import Predicate
from weftline.operators import changes, introspect, policies
from weftline.operators.changes import Changer, Conflict, Result
from weftline.plans.catalog import Catalog
from weftline.plans.elements import Select
from weftline.plans.shape import Shaper
from weftline.sources.folder import Folder
from weftline.sources.store import Binding, Store


class Graph:
    """Queries return lazy DataFrames; changes replace the store's tables when they have worked as a whole.

    With a ``folder`` each change is written there as a version, and a graph opened on it later has the latest one.
    Dates and times are those of UTC, which the session must have as its time zone.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, module: str = "default", context: policies.Context | None = None, folder: str | None = None):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.catalog, self.module = spark, catalog, module
        self.context = context or policies.Context()
        self.store = Store(spark, catalog)
        self.version, self.history, self.batches = 0, [], {}
        self.kept = Folder(spark, folder) if folder else None
        if self.kept and self.kept.versions():
            self.version, self.history, self.batches = self.kept.load(self.store)

    def saved(self) -> None:
        """Write what has changed as the next version, if the graph has a folder."""
        if self.kept:
            self.kept.save(self.store, self.version, self.history, self.batches)

    def shaper(self, store: Store | None = None, seen: bool = True) -> Shaper:
        shaper = Shaper(store or self.store, self.module, run=self)
        if seen:
            shaper.visible = lambda name: policies.condition(self.catalog, shaper, self.context, name, "select")
        return shaper

    def as_user(self, **context: Any) -> Graph:
        """The same graph for another caller; changes of one are not seen by the other."""
        out = Graph(self.spark, self.catalog, self.module, replace(policies.Context(superuser=False), **context))
        out.store, out.version, out.history = self.store.copy(), self.version, self.history
        return out

    def in_module(self, module: str) -> Graph:
        out = Graph(self.spark, self.catalog, module, self.context)
        out.store, out.version, out.history, out.batches, out.kept = self.store, self.version, self.history, self.batches, self.kept
        return out

    def register(self, name: str, binding: Binding) -> None:
        self.store.register(self.catalog.resolve(name, self.module), binding)

    # queries

    def select(self, query: Select | str, *shape: Any, **clauses: Any) -> DataFrame:
        """A query, or a type with its shape and clauses."""
        if isinstance(query, str):
            query = Select(query, shape or ("id",), **clauses)
        return self.shaper().select(query)

    def free(self, **entries: Any) -> DataFrame:
        """One row: values of expressions, and arrays of the rows of queries."""
        shaper = self.shaper()
        df, columns = self.spark.range(1), []
        for name, value in entries.items():
            got = value if isinstance(value, Select) else shaper.expression(value)
            if isinstance(got, Select):
                df, column = shaper.constant(df, shaper.gathered(got))
            else:
                column = getattr(got, "col", got)
            columns.append(column.alias(name) if hasattr(column, "alias") else F.lit(column).alias(name))
        return df.select(*columns)

    def values(self, expression: Any, name: str = "value") -> DataFrame:
        """The values of an expression: one row for each element of a set."""
        got = self.shaper().expression(expression)
        column = F.explode(got.col) if got.kind == "set" else got.col
        return self.spark.range(1).select(column.alias(name))

    def first(self, type_name: str, field: str) -> DataFrame:
        """A property of the type's first object by id: no row or one."""
        return self.select(Select(type_name, (field,), order_by="id", limit=1))

    def object_types(self) -> DataFrame:
        return introspect.object_types(self.spark, self.catalog)

    # changes

    def _changed(self, change: Callable[[Changer], Result]) -> Result:
        changer = Changer(self)
        result = change(changer)
        changer.commit()
        return result

    def insert(self, type_name: str, values: Mapping[str, Any], conflict: Conflict | None = None) -> Result:
        return self._changed(lambda c: c.insert(type_name, values, conflict))

    def update(self, type_name: str, values: Mapping[str, Any], where: Predicate | None = None) -> Result:
        return self._changed(lambda c: c.update(type_name, where, values))

    def delete(self, type_name: str, where: Predicate | None = None) -> Result:
        return self._changed(lambda c: c.delete(type_name, where))

    def for_each(self, values: Iterable[Any], insert: Callable[[Any], tuple[str, Mapping[str, Any]]]) -> Result:
        return changes.for_each(self, values, insert)

    def insert_rows(self, type_name: str, rows: DataFrame) -> None:
        changes.insert_rows(self, type_name, rows)


_STRICT = {
    "datetime": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})",
    "local_datetime": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?",
    "local_date": r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])",
    "local_time": r"([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?",
    "duration": r"[-+]?P.*",
    "relative_duration": r"[-+]?P.*",
    "date_duration": r"[-+]?P.*",
}


def _is_uuid(value: Any) -> bool:
    """Whether a text is a UUID of versions 1 to 5, written with its hyphens."""
    try:
        read = uuid.UUID(value)
    except (AttributeError, TypeError, ValueError):
        return False
    return str(read) == value.lower() and read.variant == uuid.RFC_4122 and read.version in range(1, 6)


def parameter(kind: str, name: str, values: Mapping[str, Any]) -> Any:
    """A query parameter, checked strictly against its type."""
    if name not in values:
        raise semantic(f"missing parameter ${name}")
    value, short = values[name], kind.rpartition("::")[2]
    fits = {
        "str": lambda v: isinstance(v, str),
        "bool": lambda v: isinstance(v, bool),
        "int": lambda v: isinstance(v, int) and not isinstance(v, bool),
        "float": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    }.get({"int16": "int", "int32": "int", "int64": "int", "float32": "float", "float64": "float"}.get(short, short))
    if short == "uuid":
        fits = _is_uuid
    if fits is None:
        fits = lambda v: isinstance(v, str) and re.fullmatch(_STRICT.get(short, "(?!)"), v) is not None
    if not fits(value):
        raise semantic(f"Cannot cast ${name} to {short}")
    return value
