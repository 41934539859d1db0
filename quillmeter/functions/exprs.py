"""Small column expressions shared by the operators. All stay inside JVM code generation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch, for zoned and zone-less timestamps alike."""
    return F.unix_micros(col(ts).cast("timestamp"))


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: ties go up, as in browser and server JavaScript."""
    p = float(10**digits)
    return F.floor(x * F.lit(p) + F.lit(0.5)).cast("double") / F.lit(p)


def any_contains(text: str | Column, needles: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (col(text).contains(n) for n in needles))


def count_contains(text: str | Column, needles: Sequence[str]) -> Column:
    """How many of the words occur; a repeated word counts each time. Plain sums stay in generated code."""
    return reduce(lambda a, b: a + b, (col(text).contains(n).cast("long") for n in needles))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def lookup(table: Mapping[str, object], key: str | Column, default: object = None) -> Column:
    """Look a key up in a fixed literal map. No join: the table lives in the expression."""
    pairs: list[Column] = []
    for k, v in table.items():
        pairs += [F.lit(k), F.lit(v)]
    hit = F.try_element_at(F.create_map(*pairs), col(key))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def first_rule(rules: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    """Ordered rule chain: the value of the first condition that holds."""
    chain = None
    for cond, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(cond, v) if chain is None else chain.when(cond, v)
    tail = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return chain.otherwise(tail)


def labels_where(pairs: Iterable[tuple[Column, str]], sep: str = ";") -> Column:
    """Names of the conditions that hold, in order, joined into one string."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs])), sep)


def long_count(cond: Column) -> Column:
    return F.count_if(cond).cast("long")
