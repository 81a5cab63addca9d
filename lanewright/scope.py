"""Partial runs: a frozen set of lanes at one stored map step."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.operators import sampling

if TYPE_CHECKING:
    from lanewright.pipeline import Pipeline


@dataclass
class Scope:
    """Lanes at a step, as a list or as a frame with a column lane."""

    step: str
    chosen: Sequence[str] | DataFrame
    origin: dict[str, Any] = field(default_factory=dict)

    def lanes(self, spark: SparkSession) -> DataFrame:
        if isinstance(self.chosen, DataFrame):
            return self.chosen.select("lane").distinct()
        return spark.createDataFrame([(x,) for x in sorted(set(self.chosen))], "lane string")

    def check(self, pipeline: Pipeline, targets: Sequence[str] | None) -> None:
        found = pipeline.by_name.get(self.step)
        if found is None:
            raise ValueError(f"unknown step {self.step}")
        if not found.depends_on:
            raise ValueError("a scope can't be at a root")
        if found.shape != "map" or not found.stored:
            raise ValueError("a scope is at a stored map step")
        outside = set(targets or ()) - pipeline.descendants(self.step)
        if outside:
            raise ValueError(f"targets outside the scope: {sorted(outside)}")


def explicit(step: str, lanes: Sequence[str]) -> Scope:
    return Scope(step, list(lanes), {"kind": "explicit", "n": len(set(lanes))})


def from_cells(step: str, cells: DataFrame) -> Scope:
    return Scope(step, cells.select("lane"), {"kind": "cells"})


def sample_n(step: str, lanes: DataFrame, n: int, seed: str) -> Scope:
    return Scope(step, sampling.sample_n(lanes, n, seed), {"kind": "sample_n", "n": n, "seed": seed})


def sample_fraction(step: str, lanes: DataFrame, fraction: float, seed: str) -> Scope:
    return Scope(step, sampling.sample_fraction(lanes, fraction, seed), {"kind": "sample_fraction", "fraction": fraction, "seed": seed})


def accounting(scope: Scope, cells: DataFrame) -> DataFrame:
    """(lane, reached) of every lane that was asked for; cells are those of a run at the scope's step."""
    asked = scope.lanes(cells.sparkSession)
    return asked.join(cells.select("lane", F.lit(True).alias("reached")).distinct(), "lane", "left").select("lane", F.coalesce("reached", F.lit(False)).alias("reached"))
