"""The schema of a graph: modules, object types with inheritance, links, computeds, functions and behaviours."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from weftline.errors import semantic
from weftline.functions.predicates import Predicate

#: Engine scalars and the Spark types that hold them.
SCALARS = {
    "str": "string",
    "int": "bigint",
    "float": "double",
    "bool": "boolean",
    "json": "string",
    "uuid": "string",
    "datetime": "string",
    "local_datetime": "string",
    "local_date": "string",
    "local_time": "string",
    "duration": "string",
    "relative_duration": "string",
    "date_duration": "string",
}
#: Other spellings of scalars.
SPELLINGS = {"bytes": "str", "int16": "int", "int32": "int", "int64": "int", "bigint": "int", "float32": "float", "float64": "float", "decimal": "float"}
OPERATIONS = ("select", "insert", "update_read", "update_write", "delete")


@dataclass(frozen=True)
class Constraint:
    """What is declared of a property's values, such as exclusive; it is described, not enforced."""

    name: str
    annotations: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Property:
    name: str
    type: str = "str"
    required: bool = False
    multi: bool = False
    annotations: Mapping[str, str] = field(default_factory=dict)
    overloaded: bool = False
    constraints: tuple[Constraint, ...] = ()


@dataclass(frozen=True)
class Link:
    name: str
    target: str
    multi: bool = False
    required: bool = False
    props: tuple[Property, ...] = ()
    annotations: Mapping[str, str] = field(default_factory=dict)
    overloaded: bool = False


@dataclass(frozen=True)
class Computed:
    """A member whose value is an element of a shape (see ``weftline.plans.elements``)."""

    name: str
    element: Any
    annotations: Mapping[str, str] = field(default_factory=dict)
    overloaded: bool = False


@dataclass(frozen=True)
class Policy:
    """``effect`` allow or deny; ``when`` is None (always), a predicate on the row, or a function of the context."""

    name: str
    effect: str
    operations: tuple[str, ...]
    when: Predicate | Callable[[Any], Predicate | bool] | None = None
    message: str | None = None


@dataclass(frozen=True)
class Trigger:
    """After ``event`` (insert, update or delete): insert into ``target``, with values of old(name), new(name) or literals.

    ``when_changed`` names a property that must differ between the old and the new row.
    """

    name: str
    event: str
    target: str
    values: Mapping[str, Any]
    when_changed: str | None = None


@dataclass(frozen=True)
class old:  # noqa: N801
    name: str


@dataclass(frozen=True)
class new:  # noqa: N801
    name: str


@dataclass(frozen=True)
class Rewrite:
    """On the events named, the property gets ``value``: a literal, new(name), old(name) or "now" as a function call."""

    name: str
    events: tuple[str, ...]
    value: Any


@dataclass(frozen=True)
class UserFunction:
    """``body`` takes the arguments: expressions of elements make a column; with ``query`` or ``modifying`` it is a function
    of the graph, which runs a query, and of the arguments.

    ``named`` parameters are only given by name. Parameters in ``defaults`` or ``optional`` may be left out: they get
    their default, or null. What is given beyond ``params`` goes to ``variadic``.
    """

    name: str
    params: tuple[str, ...]
    body: Callable[..., Any]
    module: str = "default"
    optional: tuple[str, ...] = ()
    variadic: str | None = None
    modifying: bool = False
    query: bool = False
    named: tuple[str, ...] = ()
    defaults: Mapping[str, Any] = field(default_factory=dict)

    def bound(self, args: Sequence[Any], named: Mapping[str, Any]) -> list[tuple[str, Any]] | None:
        """The parameters with what is given for them, or None if the arguments do not fit."""
        places = [p for p in self.params if p not in self.named]
        if len(args) > len(places) and not self.variadic:
            return None
        given = dict(zip(places, args, strict=False))
        if set(named) & set(given) or not set(named) <= set(self.params):
            return None
        given |= named
        out = []
        for p in self.params:
            if p not in given and p not in self.defaults and p not in self.optional:
                return None
            out.append((p, given.get(p, self.defaults.get(p))))
        return out + [(self.variadic, v) for v in args[len(places) :]]


@dataclass(frozen=True)
class ObjectType:
    name: str
    members: tuple[Property | Link | Computed, ...] = ()
    bases: tuple[str, ...] = ()
    abstract: bool = False
    policies: tuple[Policy, ...] = ()
    triggers: tuple[Trigger, ...] = ()
    rewrites: tuple[Rewrite, ...] = ()
    annotations: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Catalog:
    """An immutable schema; names are qualified with their module (``default`` if they have none)."""

    types: Mapping[str, ObjectType] = field(default_factory=dict)
    enums: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    functions: tuple[UserFunction, ...] = ()

    @staticmethod
    def of(*types: ObjectType, enums: Mapping[str, tuple[str, ...]] | None = None, functions: tuple[UserFunction, ...] = ()) -> Catalog:
        named = {qualified(t.name): replace(t, name=qualified(t.name), bases=tuple(map(qualified, t.bases))) for t in types}
        catalog = Catalog(named, {qualified(k): tuple(v) for k, v in (enums or {}).items()}, tuple(functions))
        for name in named:
            catalog.members(name)
        return catalog

    def with_types(self, *types: ObjectType) -> Catalog:
        """A new catalog with these types added or replaced."""
        return Catalog.of(*{**self.types, **{qualified(t.name): t for t in types}}.values(), enums=self.enums, functions=self.functions)

    def resolve(self, name: str, module: str = "default", aliases: Mapping[str, str] | None = None) -> str:
        """The qualified name of a type: with aliases of modules, else in the active module, else in std."""
        head, _, tail = name.rpartition("::")
        options = [f"{(aliases or {}).get(head, head)}::{tail}"] if head else [f"{module}::{name}", f"std::{name}"]
        for option in options:
            if option in self.types:
                return option
        raise semantic(f"object type '{name}' does not exist")

    def type(self, name: str) -> ObjectType:
        return self.types[self.resolve(name)]

    def lineage(self, name: str) -> list[str]:
        """The type and all its bases, bases first by depth, each once."""
        seen: list[str] = []

        def visit(n: str) -> None:
            if n not in self.types:
                raise semantic(f"base type '{n}' does not exist")
            for base in self.types[n].bases:
                if base not in seen and base != name:
                    visit(base)
            if n not in seen:
                seen.append(n)

        visit(name)
        return seen

    def members(self, name: str) -> dict[str, Property | Link | Computed]:
        """Own and inherited members; an own member of an inherited name must be overloaded and compatible."""
        found: dict[str, Property | Link | Computed] = {}
        for base in self.lineage(name):
            inherited = self._inherited(base)
            for m in self.types[base].members:
                before = inherited.get(m.name)
                if before and not m.overloaded:
                    raise semantic(f"member '{m.name}' of '{base}' is inherited and must be declared overloaded")
                if m.overloaded and not before:
                    raise semantic(f"member '{m.name}' of '{base}' is overloaded but not inherited")
                if before:
                    self._compatible(base, before, m)
                    found[m.name] = m
                else:
                    found.setdefault(m.name, m)
        return found

    def _inherited(self, name: str) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for base in self.types[name].bases:
            if base != name:
                for k, m in self.members(base).items():
                    out.setdefault(k, m)
        return out

    def _compatible(self, owner: str, before: Any, after: Any) -> None:
        same = type(before) is type(after)
        if same and isinstance(after, Property):
            same = (before.type, before.multi) == (after.type, after.multi)
        if same and isinstance(after, Link):
            same = before.multi == after.multi and self.assignable(qualified(after.target), qualified(before.target))
        if not same:
            raise semantic(f"member '{after.name}' of '{owner}' is not compatible with the one it overloads")

    def properties(self, name: str) -> dict[str, Property]:
        return {k: m for k, m in self.members(name).items() if isinstance(m, Property)}

    def links(self, name: str) -> dict[str, Link]:
        return {k: m for k, m in self.members(name).items() if isinstance(m, Link)}

    def assignable(self, name: str, target: str) -> bool:
        return target in self.lineage(qualified(name))

    def concrete(self, name: str) -> list[str]:
        """The concrete types of a type, itself among them, by name."""
        return sorted(n for n, t in self.types.items() if not t.abstract and self.assignable(n, name))

    def collected(self, name: str, what: str) -> list[Any]:
        """Policies, triggers or rewrites of a type and its bases; a later one of the same name replaces."""
        out: dict[Any, Any] = {}
        for base in self.lineage(name):
            for x in getattr(self.types[base], what):
                out[(x.name, x.events) if isinstance(x, Rewrite) else x.name] = x
        return list(out.values())

    def enum(self, kind: str) -> tuple[str, ...] | None:
        return self.enums.get(qualified(kind))

    def spark_type(self, kind: str) -> str:
        short = kind.rpartition("::")[2]
        short = SPELLINGS.get(short, short)
        if short in SCALARS:
            return SCALARS[short]
        if self.enum(kind):
            return "string"
        if short.startswith(("array<", "tuple<")):
            return "string"
        raise semantic(f"unknown scalar type '{kind}'")

    def function(self, name: str, args: Sequence[Any], named: Mapping[str, Any], module: str = "default") -> tuple[UserFunction, list[tuple[str, Any]]] | None:
        """The first function of that name that takes the arguments, with its parameters bound to them."""
        head, _, tail = name.rpartition("::")
        for f in self.functions:
            if f.name == tail and f.module == (head or module) and (bound := f.bound(args, named)) is not None:
                return f, bound
        return None


def qualified(name: str) -> str:
    return name if "::" in name else f"default::{name}"
