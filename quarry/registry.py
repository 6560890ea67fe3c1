"""Operator registry: ``"module.function" -> callable(df, **params) -> DataFrame``.

Built by introspection of ``quarry.operators``; the question spec resolves
operator names through it. Users add an operator by adding a public
function of the same shape to one of these modules (or passing their own
mapping to ``resolve``).
"""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable

MODULES = ("relational", "profile", "stats", "timeseries", "graph", "ml", "jsonops", "pages", "questions",
           "answers", "charts")
# a module also offers what it names in ``__all__``


def operators() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for m in MODULES:
        mod = importlib.import_module(f"quarry.operators.{m}")
        for name, fn in inspect.getmembers(mod, inspect.isfunction):
            if (fn.__module__ == mod.__name__ or name in getattr(mod, "__all__", ())) and not name.startswith("_"):
                out[f"{m}.{name}"] = fn
    return out


def resolve(name: str, extra: dict[str, Callable] | None = None) -> Callable:
    if extra and name in extra:
        return extra[name]
    ops = operators()
    if name not in ops:
        raise KeyError(f"unknown operator {name!r}; known: {len(ops)} (see quarry.registry.operators())")
    return ops[name]


def describe(name: str) -> str:
    """First docstring line of an operator (for listings)."""
    doc = inspect.getdoc(resolve(name)) or ""
    return doc.splitlines()[0] if doc else ""
