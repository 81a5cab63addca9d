"""Stable samples: a lane's rank is the hash of a seed and its key."""

from __future__ import annotations

from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank(lane: Column, seed: str) -> Column:
    if not seed:
        raise ValueError("a sample needs a seed")
    return F.sha2(F.concat(F.lit(seed + "\0"), lane), 256)


def sample_n(frame: DataFrame, n: int, seed: str, lane: str = "lane") -> DataFrame:
    """The n rows of smallest rank, ties by lane."""
    if n < 0:
        raise ValueError("a sample can't have fewer than 0 rows")
    return frame.orderBy(rank(F.col(lane), seed), lane).limit(n)


def sample_fraction(frame: DataFrame, fraction: float, seed: str, lane: str = "lane") -> DataFrame:
    """Rows whose rank is in the lowest fraction; samples of one seed are nested."""
    if not 0 <= fraction <= 1:
        raise ValueError("a fraction is between 0 and 1")
    if fraction == 1:
        return frame
    return frame.where(rank(F.col(lane), seed) < F.lit(threshold(fraction)))


def threshold(fraction: float) -> str:
    with localcontext() as c:
        c.prec = 100
        return f"{int(Decimal(repr(fraction)) * (1 << 256)):064x}"
