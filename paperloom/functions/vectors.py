"""Vectors as arrays of numbers, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 384
PLACEHOLDER = "__EMPTY_CHUNK_PLACEHOLDER__"


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def health(v: Column) -> dict[str, Column]:
    """F37."""
    n = norm(v)
    return {"norm": n, "has_nan": F.exists(doubles(v), lambda x: F.isnan(x)), "is_zero": F.forall(doubles(v), lambda x: x == 0), "is_unit": F.abs(n - 1) <= 0.01}


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` has it inside a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def hash_embedding(text: Column, dim: int = DIM) -> Column:
    """SHA-256 bytes of the trimmed text as numbers from -1 to 1, repeated, at unit length."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    digest = F.sha2(F.when(t == "", F.lit(PLACEHOLDER)).otherwise(t), 256)
    every = F.array(*(F.lit(2 * i + 1) for i in range(32)))
    raw = _let(digest, lambda h: F.transform(every, lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0))
    repeats, rest = divmod(dim, 32)

    def unit(r: Column) -> Column:
        whole = F.flatten(F.array_repeat(r, repeats)) if not rest else F.concat(F.flatten(F.array_repeat(r, repeats)), F.slice(r, 1, rest))
        return _let(norm(whole), lambda n: F.transform(whole, lambda x: F.when(n > 0, x / n).otherwise(x)))

    return _let(raw, unit)
