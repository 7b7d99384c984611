"""Scalar functions with the semantics programs rely on: C integers, and the distance of the A* heuristic."""

from __future__ import annotations

import time

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX = 2147483647
#: Fixed value: earth radius in centimetres.
EARTH_RADIUS_CM = 637100000.0


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero; null (not an error) on a zero divisor."""
    safe = F.when(b != 0, b)
    q = F.floor(F.abs(a) / F.abs(safe)).cast("long")
    return F.when((a < 0) != (b < 0), -q).otherwise(q)


def fabs(x: Column) -> Column:
    return F.abs(x)


def floor(x: Column) -> Column:
    return F.floor(x)


def log(x: Column) -> Column:
    """Natural logarithm."""
    return F.log(x)


def to_double(x: Column) -> Column:
    return x.cast("double")


def maximum(a: Column, b: Column) -> Column:
    """The larger value; the first argument is truncated to an integer."""
    return F.greatest(a.cast("int"), b)


def atoi(text) -> int | Column:
    """Leading integer of a string; 0 without one. Python strings or columns."""
    if isinstance(text, Column):
        return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0))
    import re

    m = re.match(r"\s*([+-]?\d+)", text)
    return int(m[1]) if m else 0


def argument(args: list[str], i: int) -> str:
    """Program argument i; ValueError if it is missing."""
    if i >= len(args):
        raise ValueError(f"missing argument {i}")
    return args[i]


def xor(a: Column, b: Column) -> Column:
    return a != b


def great_circle_cm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Heuristic distance in cm, truncated to int. Takes the sine of the whole difference, not of its half."""
    dy, dx = F.sin(lat1 - lat2), F.sin(lon1 - lon2)
    a = dy * dy + dx * dx * F.cos(lat1) * F.cos(lat2)
    return (2 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0)))) * EARTH_RADIUS_CM).cast("int")


class Timer:
    """start() and stop() around an action; seconds."""

    def start(self) -> None:
        self._at = time.perf_counter()

    def stop(self) -> float:
        return time.perf_counter() - self._at
