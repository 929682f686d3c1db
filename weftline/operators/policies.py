"""Access policies: which rows a caller sees, and which changes are refused."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import runtime
from weftline.plans.catalog import Catalog, Policy
from weftline.plans.shape import Shaper

MODIFY = "sys::perm::data_modification"


@dataclass(frozen=True)
class Context:
    """Who asks: a superuser passes every policy; permissions and globals are what conditions look at."""

    superuser: bool = True
    permissions: frozenset[str] = frozenset()
    globals: Mapping[str, Any] = field(default_factory=dict)

    def get(self, name: str) -> Any:
        """A global by its full or short name; a permission's name is true if it is held."""
        if name in self.globals:
            return self.globals[name]
        short = name.rpartition("::")[2]
        if short in self.globals:
            return self.globals[short]
        return name in self.permissions


def may_modify(context: Context) -> None:
    if not context.superuser and MODIFY not in context.permissions:
        raise runtime(f"permission '{MODIFY}' is needed for data_modification")


def condition(catalog: Catalog, shaper: Shaper, context: Context, name: str, operation: str) -> Column | None:
    """True for rows on which the operation is allowed: some allow policy holds and no deny policy; None: no limits.

    It may be null for rows that are not allowed, so that scans can use a plain comparison.
    """
    policies: list[Policy] = catalog.collected(name, "policies")
    if context.superuser or not policies:
        return None
    mine = [p for p in policies if operation in p.operations or "all" in p.operations]

    def holds(p: Policy) -> Column:
        when = p.when(context) if callable(p.when) else p.when
        if when is None or isinstance(when, bool):
            return F.lit(when is None or when)
        return shaper.condition(when, name, [name])

    either = lambda effect: reduce(lambda a, b: a | b, [holds(p) for p in mine if p.effect == effect] or [F.lit(False)])
    allowed = either("allow")
    return allowed & ~F.coalesce(either("deny"), F.lit(False)) if any(p.effect == "deny" for p in mine) else allowed


def check(catalog: Catalog, shaper: Shaper, context: Context, name: str, operation: str, rows: DataFrame) -> None:
    """Fails if a row of ``rows`` (a frame of the type) may not be changed in this way."""
    allowed = condition(catalog, shaper, context, name, operation)
    if allowed is not None and not rows.where(~F.coalesce(allowed, F.lit(False))).isEmpty():
        messages = [p.message for p in catalog.collected(name, "policies") if p.message and (operation in p.operations or "all" in p.operations)]
        raise runtime(f"Access policy violation on {operation} of {name}" + (f": {messages[0]}" if messages else ""))
