"""Expressions that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where a lambda inside uses it for each element."""
    return F.transform(F.array(value), body)[0]


def upto(n: Column) -> Column:
    """0, 1, ..., n - 1; empty for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def piece(values: Column, start: Column, n: Column) -> Column:
    """n values from an index on.  For use inside lambdas, where slice would copy the whole array each time."""
    return F.transform(upto(n), lambda i: F.get(values, start + i))


def _shifted(values: Column, n: Column, by: int, body: Callable[[Column, Column], Column]) -> Column:
    """body(values[i], values[i + by]) for each i with both."""
    return F.zip_with(F.slice(values, 1, F.greatest(n - by, F.lit(0))), F.slice(values, by + 1, F.greatest(n - by, F.lit(0))), body)


def changes(values: Column, n: Column) -> Column:
    """Indexes below n at which a value differs from the one before."""
    return let(
        values,
        lambda v: F.when(n > 0, F.concat(F.array(F.lit(0)), F.filter(F.transform(_shifted(v, n, 1, lambda a, b: a != b), lambda new, i: F.when(new, i + 1)), lambda i: i.isNotNull()))).otherwise(F.array().cast("array<int>")),
    )


def grams(hashes: Column, n: Column, width: int) -> Column:
    """A hash of each run of ``width`` hashes, built up from runs of half the length; n is the number of hashes."""

    def build(h: Column, size: int, have: Column, have_n: Column, of: int) -> Column:
        if size == of:
            return have
        if size >= 2 * of:
            return let(_shifted(have, have_n, of, lambda a, b: F.xxhash64(a, b)), lambda x: build(h, size, x, have_n - of, 2 * of))
        rest = size - of
        tail = grams(h, n, rest) if rest > 1 else h
        left = F.greatest(n - (size - 1), F.lit(0))
        return let(tail, lambda t: F.zip_with(F.slice(have, 1, left), F.slice(t, of + 1, left), lambda a, b: F.xxhash64(a, b)))

    return let(hashes, lambda h: build(h, width, h, n, 1))


def window_minima(values: Column, n: Column, width: int) -> Column:
    """The smallest of each window of ``width`` values, from minima of half the width; n is the number of values."""

    def build(x: Column, count: Column, of: int) -> Column:
        step = min(of, width - of)
        return x if not step else let(_shifted(x, count, step, lambda a, b: F.least(a, b)), lambda y: build(y, count - step, of + step))

    return F.when(n >= width, let(values, lambda v: build(v, n, 1))).otherwise(F.slice(values, 1, 0))
