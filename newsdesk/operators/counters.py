"""Counters of a job, gathered by the job that does the work."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation


def counted(df: DataFrame, **values: Column) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """``df`` that counts aggregate ``values`` as it is run, and a call that waits for them after the action.

    The action must run ``df`` itself, wholly and once; a name of its own keeps each from what else is observed.
    """
    seen = Observation(f"counters-{uuid.uuid4().hex}")
    return df.observe(seen, *[v.alias(k) for k, v in values.items()]), lambda: dict(seen.get)
