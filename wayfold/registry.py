"""Named, user-extendable functions: filters, metrics, advantages, formats, converters and scorers.

Registering another function under a taken name is an error.  User scorers become
Arrow-batched UDFs; generators may be registered as table functions with ``udtf``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

KINDS = ("filter", "metric", "advantage", "format", "converter", "scorer")
_ENTRIES: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str):
    """Decorator: make ``fn`` available as ``kind``/``name``."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}, expected one of {KINDS}")

    def add(fn: Callable) -> Callable:
        old = _ENTRIES.get((kind, name))
        if old is not None and old is not fn:
            raise ValueError(f"{kind} {name!r} is already registered")
        _ENTRIES[(kind, name)] = fn
        return fn
    return add


def get(kind: str, name: str) -> Callable:
    try:
        return _ENTRIES[(kind, name)]
    except KeyError:
        raise KeyError(f"no {kind} named {name!r}; known: {names(kind)}") from None


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _ENTRIES if k == kind)


def vectorised(fn: Callable, returns: str = "double"):
    """Arrow-batched UDF from a function of pandas Series."""
    return F.pandas_udf(fn, returns)


def _defaults() -> None:
    from wayfold.operators import parsing, rewards, scoring

    for name in ("grpo", "rloo", "opo", "gpg", "grpo_passk"):
        register("advantage", name)(getattr(rewards, name))
    register("filter", "topk_variance")(rewards.filter_topk_variance)
    register("filter", "topp_variance")(rewards.filter_topp_variance)
    register("metric", "reward_variance")(rewards.reward_variance)
    for name in ("alpaca", "sharegpt", "pair"):
        register("converter", name)(getattr(parsing, f"convert_{name}"))
    register("format", "responses")(parsing.format_check)
    register("scorer", "strict_number")(scoring.strict_number)
    register("scorer", "last_number")(scoring.last_number)


_defaults()
