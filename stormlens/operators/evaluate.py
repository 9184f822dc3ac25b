"""Detector evaluation: rank AUC, recall at a false-alarm budget, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlens.operators.quantiles import running_totals
from stormlens.session import cut


def rank_auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Mann-Whitney AUC with ties counted half; one row (auc, n_pos, n_neg), null if a side is empty.

    Rows are first reduced to distinct scores; the running count of negatives is carried
    over blocks of scores.
    """
    pos = F.col(positive)
    t = running_totals(df.where(pos.isNotNull()), score, {
        "p": F.sum(pos.cast("bigint")), "q": F.sum((~pos).cast("bigint"))})
    wins = F.col("p").cast("double") * (F.col("cum_q") - F.col("q") + F.col("q") * 0.5)
    total = t.agg(F.sum(wins).alias("w"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    both = F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))
    return total.select((F.col("w") / both).alias("auc"), "n_pos", "n_neg")


def recall_at_budget(df: DataFrame, score: str, positive: str, weight: str, negative_hours: float,
                     per_hour: float = 1.0) -> DataFrame:
    """Highest threshold whose false alarms on the negatives stay within the budget.

    allowed = floor(per_hour * hours); the threshold is the (allowed + 1)-th highest negative
    score, or the lowest if there are not that many. Hits are strictly above it. `weight` is
    the number of arrivals a positive stands for.
    """
    allowed = int(per_hour * negative_hours)
    pos = F.col(positive)
    t = cut(running_totals(df.withColumn("__neg", -F.col(score)), "__neg", {
        "q": F.sum((~pos).cast("bigint"))}))
    kth = t.where((F.col("q") > 0) & (F.col("cum_q") >= allowed + 1)).agg((-F.min("__neg")).alias("x"))
    low = t.where(F.col("q") > 0).agg((-F.max("__neg")).alias("x"))
    thr = F.coalesce(kth.scalar(), low.scalar())
    hit = (F.col(score) > thr) & pos
    return df.agg(
        F.max(thr).alias("threshold"), F.lit(allowed).cast("bigint").alias("allowed"),
        F.sum(hit.cast("bigint")).alias("clips_hit"), F.sum(pos.cast("bigint")).alias("clips"),
        F.sum(F.when(hit, F.col(weight)).otherwise(0)).cast("bigint").alias("arrivals_hit"),
        F.sum(F.when(pos, F.col(weight)).otherwise(0)).cast("bigint").alias("arrivals"))


def compare_scores(df: DataFrame, scores: list[str], positive: str, weight: str, negative_hours: float
                   ) -> DataFrame:
    """AUC and operating point of several score columns on the same labels."""
    df = cut(df)
    out = None
    for s in scores:
        a = rank_auc(df, s, positive).withColumn("k", F.lit(s))
        r = recall_at_budget(df, s, positive, weight, negative_hours).withColumn("k", F.lit(s))
        one = a.join(r, "k").withColumnRenamed("k", "score")
        out = one if out is None else out.unionByName(one)
    return out


def evaluation_summary(matched: DataFrame, unmatched_found: DataFrame, clips: DataFrame, *, found_km: str,
                       truth_km: str, false_alarms: DataFrame, duration_s: str) -> DataFrame:
    """Recall k of n, median range error, unmatched detections, false alarms per hour."""
    from stormlens.operators.quantiles import exact_quantile
    err = matched.where(F.col("dt").isNotNull() & F.col(found_km).isNotNull()).select(
        F.abs(F.col(found_km) - F.col(truth_km)).alias("e"))
    med = exact_quantile(err, [], "e", 0.5, "m")
    base = matched.agg(F.count("dt").alias("n_hit"), F.count(F.lit(1)).alias("n_truth"))
    hours = clips.agg((F.sum(duration_s) / 3600.0).alias("h"))
    return base.select(
        "n_hit", "n_truth", med.scalar().alias("median_range_error"),
        unmatched_found.agg(F.count(F.lit(1)).alias("u")).scalar().alias("n_unmatched"),
        (false_alarms.agg(F.count(F.lit(1)).alias("u")).scalar() / hours.scalar()).alias("false_alarms_per_hour"))


def label_clips(clips: DataFrame, arrivals_col: str, control_col: str) -> DataFrame:
    """positive: at least one arrival; negative: control window; others stay unlabelled (null)."""
    label = F.when(F.col(arrivals_col) > 0, True).when(F.col(control_col), False)
    return clips.withColumn("positive", label)
