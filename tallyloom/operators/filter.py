"""Filters by abundance and recurrence among UP and DOWN samples: row-local, no shuffle."""

from __future__ import annotations

import logging

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vec
from ..matrix import FeatureMatrix

log = logging.getLogger(__name__)


def recurrence(counts: Column, places: list[int], test) -> Column:
    """The number of the given samples whose count passes a test."""
    return F.size(F.filter(vec.pick(counts, places), test))


def recurrent(counts: Column, status: list[str | None], up_min: tuple[float, int], down_max: tuple[float, int]) -> Column:
    """At least R of the UP samples have a count of A or more, and at least R of the DOWN samples one of A or less."""
    up, down = ([i for i, s in enumerate(status) if s == want] for want in ("UP", "DOWN"))
    return (recurrence(counts, up, lambda x: x >= float(up_min[0])) >= int(up_min[1])) & (recurrence(counts, down, lambda x: x <= float(down_max[0])) >= int(down_max[1]))


def filter_features(m: FeatureMatrix, status: list[str | None], up_min: tuple[float, int] = (0, 0), down_max: tuple[float, int] = (float("inf"), 0), reverse: bool = False) -> FeatureMatrix:
    """Keep the features that are recurrent (reverse: those that aren't)."""
    for name, (_, r) in (("UP", up_min), ("DOWN", down_max)):
        if status.count(name) < r:
            log.warning("fewer %s samples than the recurrence asked for", name)
    keep = recurrent(F.col("counts"), status, up_min, down_max)
    return m.with_df(m.df.where(~keep if reverse else keep))
