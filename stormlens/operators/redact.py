"""Redaction of secrets in whole texts, and the report of lines that still look risky."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlens.functions.text import REDACTION_MARK, REDACTION_PATTERNS, SUSPICIOUS_LINE


STAND_IN = "\ue0f1\ue0f2\ue0f3"   # private-use characters


def _java(pattern: str) -> str:
    """Unicode-aware character classes, as in the original definition of the patterns."""
    return "(?U)" + pattern


def redact(df: DataFrame, text: str, secrets: list[str] | None = None, patterns=REDACTION_PATTERNS) -> DataFrame:
    """Replace exact secrets (longest first), then each pattern in order.

    Adds `redacted` and `counts` (map class -> replacements). Each count is taken on the text
    as the previous step left it.
    """
    def marks(mark: str):
        return ((F.length("__t") - F.length(F.replace(F.col("__t"), F.lit(mark), F.lit("")))) / len(mark)).cast("bigint")

    x, pairs = df.withColumn("__t", F.col(text)), []
    exact = [("exact-secret", s) for s in sorted(set(secrets or []), key=lambda v: (-len(v), v))]
    x = x.withColumn("__n", F.lit(0).cast("bigint"))
    for _, s in exact:
        x = x.withColumn("__n", F.col("__n") + marks(s))
        x = x.withColumn("__t", F.replace(F.col("__t"), F.lit(s), F.lit("[REDACTED:exact]")))
    pairs += [F.lit("exact-secret"), F.col("__n")]
    for i, (name, pattern, group) in enumerate(patterns):
        # a stand-in is put in, counted and then turned into the mark: one regex pass per pattern
        x = x.withColumn("__t", F.regexp_replace(
            "__t", F.lit(_java(pattern)), F.lit((f"${group}" if group else "") + STAND_IN)))
        x = x.withColumn(f"__a{i}", marks(STAND_IN))
        x = x.withColumn("__t", F.replace(F.col("__t"), F.lit(STAND_IN), F.lit(f"[REDACTED:{name}]")))
        pairs += [F.lit(name), F.col(f"__a{i}")]
    return x.select(*df.columns, F.col("__t").alias("redacted"), F.create_map(*pairs).alias("counts"))


def class_totals(redacted: DataFrame, patterns=REDACTION_PATTERNS) -> DataFrame:
    """(class, n) over all documents, summed before anything is turned into rows."""
    names = ["exact-secret", *[p[0] for p in patterns]]
    one = redacted.agg(*[F.sum(redacted.counts[n]).alias(n) for n in names])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("class"), F.col(f"`{n}`").alias("n")) for n in names])).alias("r")).select("r.*")


def residual_risk(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, line number from 1, line) of lines that look risky and carry no redaction mark."""
    lines = df.select(*key, F.posexplode(F.split(text, "\n")).alias("__p", "line"))
    risky = F.col("line").rlike(SUSPICIOUS_LINE) & ~F.contains(F.col("line"), F.lit(REDACTION_MARK))
    return lines.where(risky).select(*key, (F.col("__p") + 1).alias("line_no"), "line")
