"""Small Column helpers used all over the package."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame

from crawlscope.functions.sql import F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def choose(*branches: tuple[Column, Column | str | None], default: Column | str | None = None) -> Column:
    """CASE WHEN as a list of (condition, value) pairs."""
    first, *rest = branches
    out = F.when(first[0], _value(first[1]))
    for cond, value in rest:
        out = out.when(cond, _value(value))
    return out.otherwise(_value(default))


def _value(v: Column | str | None) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def when_array(*items: tuple[Column, Column], of: str = "string") -> Column:
    """Array of the values whose condition holds, in the given order."""
    slots = F.array(*[F.when(cond, _value(value)) for cond, value in items])
    return F.coalesce(F.filter(slots, lambda x: x.isNotNull()), F.array().cast(f"array<{of}>"))


def in_words(value: Column, words: Iterable[str]) -> Column:
    return value.isin(list(words))


def each(df: DataFrame, keys: list, values: Column, name: str) -> DataFrame:
    """One row per array element.

    A plain explode makes the optimizer test the array before it explodes it, which evaluates a computed array
    (an extraction) a second and a third time. The outer form with a filter behind it evaluates it once.
    """
    return df.select(*keys, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())
