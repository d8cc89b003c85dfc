"""Named column builders that users can extend.

A builder takes the parameters of a request and returns an aggregate Column over
per-trace rows; ``case_table`` evaluates any set of names in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

_builders: dict[str, Callable[..., Column]] = {}


def register(name: str) -> Callable:
    def keep(fn: Callable[..., Column]) -> Callable[..., Column]:
        _builders[name] = fn
        return fn

    return keep


def names() -> list[str]:
    return sorted(_builders)


def build(name: str, **params) -> Column:
    if name not in _builders:
        raise KeyError(f"no feature {name}; known: {', '.join(names())}")
    return _builders[name](**params).alias(name)


def case_table(traces: DataFrame, wanted: Sequence[str], keys: Sequence[str] = ("case_id",), **params) -> DataFrame:
    return traces.groupBy(*keys).agg(*[build(n, **params) for n in wanted])


@register("Branches")
def _branches(res: float = 1.0) -> Column:
    return F.count("*")


@register("Length")
def _length(res: float = 1.0) -> Column:
    return F.sum("length") * res


@register("Volume")
def _volume(res: float = 1.0) -> Column:
    return F.sum("volume") * res**3


@register("Tortuosity")
def _tortuosity(res: float = 1.0) -> Column:
    total = F.sum("length")
    return F.when(total == 0, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.sum(F.col("tortuosity") * F.col("length")), total), F.lit(0.0)))
