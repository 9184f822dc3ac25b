"""Reviewer actions to decisions, directives and labelled examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlens.functions.text import action_label, action_text
from stormlens.operators.joins import pick_first

# Labels that lead to a directive, and labels used for training.
DIRECTIVES = {"confirmed_smoke": "prioritize_sector", "keep_watching": "extend_watch"}
TRAINING = {"confirmed_smoke": 1, "false_positive": 0}


def decisions(actions: DataFrame) -> DataFrame:
    """actions: time, strike_id, action, reviewer, comment; adds label and human text."""
    return actions.withColumn("label", action_label("action")).withColumn("human", action_text("action"))


def directives(dec: DataFrame) -> DataFrame:
    kind = F.when(F.col("label") == "confirmed_smoke", DIRECTIVES["confirmed_smoke"]).when(
        F.col("label") == "keep_watching", DIRECTIVES["keep_watching"])
    return dec.select("time", "strike_id", kind.alias("directive"), "reviewer").where(F.col("directive").isNotNull())


def last_decision(dec: DataFrame, order: list[str]) -> DataFrame:
    return pick_first(dec, ["strike_id"], order, ["label", "reviewer"], descending=True)


def labelled_examples(dec: DataFrame, order: list[str], strikes: DataFrame | None = None) -> DataFrame:
    """Strikes whose last training-relevant decision confirms smoke (1) or rejects it (0)."""
    t = dec.where(F.col("label").isin(list(TRAINING)))
    x = last_decision(t, order).withColumn("target", F.when(F.col("label") == "confirmed_smoke", 1).otherwise(0))
    x = x.select("strike_id", "label", "target")
    return x if strikes is None else strikes.join(x, "strike_id")
