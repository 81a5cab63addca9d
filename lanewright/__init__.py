"""Incremental lane pipelines on PySpark."""

from lanewright.home import Home
from lanewright.pipeline import Pipeline, Summary
from lanewright.scope import Scope
from lanewright.selection import Selection
from lanewright.spec import Filtered, Step, join, join_table, step, union

__all__ = ["Filtered", "Home", "Pipeline", "Scope", "Selection", "Step", "Summary", "join", "join_table", "step", "union"]
