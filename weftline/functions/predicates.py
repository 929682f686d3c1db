"""Conditions on the rows of a type: small values that combine with ``&``, ``|`` and ``~`` and become columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return Both("and", self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Both("or", self, other)

    def __invert__(self) -> Predicate:
        return Not(self)

    def leaves(self) -> Iterator[Predicate]:
        yield self


@dataclass(frozen=True)
class Both(Predicate):
    op: str
    left: Predicate
    right: Predicate

    def leaves(self):
        yield from self.left.leaves()
        yield from self.right.leaves()


@dataclass(frozen=True)
class Not(Predicate):
    inner: Predicate

    def leaves(self):
        yield from self.inner.leaves()


@dataclass(frozen=True)
class Compare(Predicate):
    """``op`` is =, !=, like, ilike, in or not in; a comparison with null is never true."""

    name: str
    op: str
    value: Any


@dataclass(frozen=True)
class TypeIs(Predicate):
    """Compares the name of a row's concrete type."""

    op: str
    value: str


@dataclass(frozen=True)
class LinkedFrom(Predicate):
    """Whether the object with an id links to the row (or, negated, does not)."""

    link: str
    source: str | None
    id: str
    negated: bool = False


@dataclass(frozen=True)
class field:  # noqa: N801
    """A property of the scanned type: ``field("name").eq("x")``."""

    name: str

    def eq(self, value: Any) -> Predicate:
        return Compare(self.name, "=", value)

    def ne(self, value: Any) -> Predicate:
        return Compare(self.name, "!=", value)

    def like(self, pattern: str) -> Predicate:
        return Compare(self.name, "like", pattern)

    def ilike(self, pattern: str) -> Predicate:
        return Compare(self.name, "ilike", pattern)

    def one_of(self, *values: Any) -> Predicate:
        return Compare(self.name, "in", values)

    def none_of(self, *values: Any) -> Predicate:
        return Compare(self.name, "not in", values)


def type_is(name: str) -> Predicate:
    return TypeIs("=", name)


def type_is_not(name: str) -> Predicate:
    return TypeIs("!=", name)


def linked_from(link: str, id: str, source: str | None = None) -> Predicate:
    return LinkedFrom(link, source, id)


def not_linked_from(link: str, id: str, source: str | None = None) -> Predicate:
    return LinkedFrom(link, source, id, True)


def like(text: Column, pattern: str) -> Column:
    """LIKE without regard to the case of A-Z, with % and _ and without an escape character."""
    folded = pattern.translate(str.maketrans(_UPPER, _LOWER))
    return F.like(F.translate(text, _UPPER, _LOWER), F.lit(folded), F.lit("\u0001"))


def compare(column: Column, op: str, value: Any) -> Column:
    if op == "=":
        return column == F.lit(value)
    if op == "!=":
        return column != F.lit(value)
    if op in ("like", "ilike"):
        return like(column, value)
    if op == "in":
        return column.isin(list(value))
    return ~column.isin(list(value))
