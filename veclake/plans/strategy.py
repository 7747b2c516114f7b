"""How a filtered approximate search is carried out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: At or below this selectivity the filter goes into the walk (fixed values).
PUSH_DOWN, MOST_WIDENING = 0.5, 10


def plan(selectivity: float, ef: int, k: int) -> tuple[str, int, int]:
    """(plan, ef, candidates to fetch) by a filter's selectivity."""
    if selectivity <= 0:
        return "empty", 0, 0
    if selectivity <= PUSH_DOWN:
        return "filter in walk", math.floor(ef * min(1 / selectivity, float(MOST_WIDENING))), k
    return "filter after walk", max(ef, 2 * k), 2 * k


def strategy(selectivity: Column, ef: int, k: int) -> Column:
    """``plan`` as a struct (plan, ef, fetch)."""

    def struct(name: str, width: Column, fetch: int) -> Column:
        return F.struct(F.lit(name).alias("plan"), width.cast("long").alias("ef"), F.lit(fetch).cast("long").alias("fetch"))

    (empty, e, f), (inside, _, g), (after, w, h) = plan(0, ef, k), plan(PUSH_DOWN, ef, k), plan(1, ef, k)
    widened = F.floor(ef * F.least(1 / selectivity, F.lit(float(MOST_WIDENING))))
    return F.when(selectivity <= 0, struct(empty, F.lit(e), f)).when(selectivity <= PUSH_DOWN, struct(inside, widened, g)).otherwise(struct(after, F.lit(w), h))
