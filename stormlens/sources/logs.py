"""Retry lists from run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def failed_units(lines: DataFrame, pattern: str, names: list[str], done: DataFrame | None = None,
                 text: str = "value") -> DataFrame:
    """Distinct units named by regex groups in error lines, minus those finished since."""
    hit = lines.where(F.col(text).rlike(pattern)).select(
        *[F.regexp_extract(text, pattern, i + 1).alias(n) for i, n in enumerate(names)]).distinct()
    return hit if done is None else hit.join(done.select(*names).distinct(), names, "left_anti")
