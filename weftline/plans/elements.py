"""The elements of a shape and the values they compute."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from weftline.functions.predicates import Predicate


@dataclass(frozen=True)
class Ref:
    """A property of the row."""

    name: str


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Many:
    """A set literal, or with ``array`` an array literal; both keep order and duplicates."""

    values: tuple
    array: bool = False


@dataclass(frozen=True)
class TypeName:
    """``{name: the row's concrete type}``."""


@dataclass(frozen=True)
class IfType:
    """A property of rows whose concrete type is exactly ``type``; null for others."""

    type: str
    name: str


@dataclass(frozen=True)
class Concat:
    """Texts joined; nulls count as empty."""

    parts: tuple


@dataclass(frozen=True)
class Call:
    """A function of arguments by place and by name."""

    function: str
    args: tuple = ()
    named: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Cast:
    """To str, json or an enum."""

    type: str
    value: Any


@dataclass(frozen=True)
class Member:
    """A member of an enum by its path."""

    enum: str
    member: str


@dataclass(frozen=True)
class Back:
    """The objects that link to the row: an array of ``{id, __type__}`` in the order of type and id, the first ``limit`` of
    them, or with ``count`` how many there are. Where very many objects link to one, only the last two are small."""

    link: str
    source: str | None = None
    limit: int | None = None
    count: bool = False


@dataclass(frozen=True)
class All:
    """All properties (and with ``deep`` the links with theirs), of a super type ``of`` or for rows of type ``only``."""

    deep: bool = False
    of: str | None = None
    only: str | None = None


@dataclass(frozen=True)
class As:
    """A computed element of a shape: a name and a value (a ``Select`` is a query that doesn't depend on the row)."""

    name: str
    value: Any


@dataclass(frozen=True)
class To:
    """A link with a nested shape and clauses; ``only`` keeps targets of a type; ``props`` adds link properties as @name."""

    link: str
    shape: tuple = ("id",)
    where: Predicate | None = None
    order_by: str | None = None
    desc: bool = False
    offset: int = 0
    limit: int | None = None
    only: str | None = None
    name: str | None = None
    props: tuple[str, ...] = ()


@dataclass(frozen=True)
class Select:
    type: str
    shape: tuple = ("id",)
    where: Predicate | None = None
    order_by: str | None = None
    desc: bool = False
    offset: int = 0
    limit: int | None = None

    def narrowed(self, **clauses: Any) -> Select:
        """This query as the source of another: conditions are combined, other clauses replace those given here."""
        where = clauses.pop("where", None)
        merged = self.where if where is None else where if self.where is None else self.where & where
        return replace(self, where=merged, **clauses)
