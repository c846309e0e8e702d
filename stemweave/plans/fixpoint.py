"""Iterate a table to its fixpoint with durable rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemweave.plans.durable import written


def rounds(most: int | None) -> Iterable[int]:
    return count() if most is None else range(most)


def fixpoint(
    state: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    changed: str = "_changed",
    max_rounds: int | None = None,
    tag: str = "round",
) -> DataFrame:
    """Apply ``step`` until no row has ``changed`` set.

    ``step`` gets the previous state without the flag and returns it with a boolean ``changed``
    column. Every round is written to the shared folder. There are as many rounds as it takes; where
    a caller sets ``max_rounds``, running out of them is an error, never a silently truncated answer.
    """
    current = state
    for _ in rounds(max_rounds):
        current = written(step(current), tag)
        more = current.filter(F.col(changed)).limit(1).count()
        current = current.drop(changed)
        if not more:
            return current
    raise RuntimeError(f"{tag}: no fixpoint after {max_rounds} rounds")
