"""Vectors as arrays: products, norms, distances, predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.errors import InvalidRequest


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def squared_euclidean(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def hamming(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))


def angular(a: Column, b: Column, floor: float = 1e-20) -> Column:
    """sqrt(2 - 2 cos); norms have a floor, and rounding never makes the root's argument negative."""
    cos = dot(a, b) / (F.greatest(l2_norm(a), F.lit(floor)) * F.greatest(l2_norm(b), F.lit(floor)))
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cos))


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {"euclidean": euclidean, "manhattan": manhattan, "hamming": hamming, "angular": angular}


def distance(kind: str, a: Column, b: Column) -> Column:
    if kind not in DISTANCES:
        raise InvalidRequest(f"no distance {kind}; there are {', '.join(DISTANCES)}")
    return DISTANCES[kind](a, b)


def normalize(v: Column, floor: float = 1e-12, flip: bool = False) -> Column:
    """Unit length; a vector whose squared length is under the floor stays. flip: with the sign turned."""
    length = l2_norm(v)
    sign = -1.0 if flip else 1.0
    return F.when(length * length < floor, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / length * sign))


def sort_ascending(v: Column) -> Column:
    return F.array_sort(v)


def sort_descending(v: Column) -> Column:
    return F.sort_array(v, False)


def filled(n: int, value: float) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def contains(v: Column, value: object) -> Column:
    return F.array_contains(v, value)


def equals(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """Same length, and no component further apart than the tolerance."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), lambda d: d <= tolerance)


def hashed(v: Column) -> Column:
    return F.xxhash64(v)
