"""Errors with a code, as callers see them."""

from __future__ import annotations


class GraphError(Exception):
    """``code`` is E_SYNTAX, E_SEMANTIC, E_VALIDATION or E_RUNTIME."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def semantic(message: str) -> GraphError:
    return GraphError("E_SEMANTIC", message)


def runtime(message: str) -> GraphError:
    return GraphError("E_RUNTIME", message)
