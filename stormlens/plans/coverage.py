"""Archive coverage: what each node uploaded, day by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlens.functions.text import ALL_BUCKETS, is_capture, is_media, media_bucket
from stormlens.functions.timecols import DAY_US, day_no
from stormlens.operators.joins import pick_first

# A task-month with more pre-aggregated rows than this per day has
# exploded and is counted from raw rows; metrics tried for the first record of a node.
MAX_BUCKET_ROWS_PER_DAY = 40
FIRST_RECORD_METRICS = ["sys.uptime", "env.temperature"]


def month_of_day(day) -> Column:
    """'yyyy-MM' of a UTC day number."""
    d = F.col(day) if isinstance(day, str) else day
    return F.date_format(F.date_from_unix_date(d.cast("int")), "yyyy-MM")


def daily_counts(uploads: DataFrame, time: str = "t") -> DataFrame:
    """Raw rows to (vsn, task, day, n_uploads); day is the UTC day number."""
    return uploads.groupBy("vsn", "task", day_no(time).alias("day")).agg(
        F.count(F.lit(1)).alias("n_uploads"))


def daily_from_buckets(buckets: DataFrame, label: str = "t", value: str = "value") -> DataFrame:
    """Pre-aggregated buckets carry the end of their day; shift once and sum."""
    return buckets.groupBy("vsn", "task", day_no(F.col(label) - DAY_US).alias("day")).agg(
        F.sum(value).cast("bigint").alias("n_uploads"))


def daily_with_guard(buckets: DataFrame, raw: DataFrame) -> DataFrame:
    """Pre-aggregated counts, but raw counts for task-months whose buckets exploded."""
    day = day_no(F.col("t") - DAY_US)
    month = month_of_day(day)
    b = buckets.withColumn("month", month)
    days = F.dayofmonth(F.last_day(F.to_date(F.concat("month", F.lit("-01")))))
    blown = b.groupBy("vsn", "task", "month").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > days * MAX_BUCKET_ROWS_PER_DAY).select("vsn", "task", "month")
    keys = ["vsn", "task", "month"]
    fine = daily_from_buckets(b.join(blown, keys, "left_anti"))
    counted = daily_counts(raw).withColumn("month", month_of_day("day")).join(blown, keys, "left_semi")
    return fine.unionByName(counted.drop("month"))


def clean_daily(daily: DataFrame, as_of_day: int | None = None) -> DataFrame:
    """Drop empty and future-dated day rows."""
    limit = F.lit(as_of_day) if as_of_day is not None else F.unix_date(F.current_date())
    return daily.where((F.col("n_uploads") > 0) & (F.col("day") <= limit))


def classify(daily: DataFrame) -> DataFrame:
    x = daily.withColumn("bucket", media_bucket("task"))
    return x.withColumn("is_media", is_media("bucket")).withColumn("is_capture", is_capture("bucket"))


def coverage(uploads: DataFrame, as_of_day: int | None = None) -> DataFrame:
    return classify(clean_daily(daily_counts(uploads), as_of_day))


def monthly(cov: DataFrame) -> DataFrame:
    """Uploads and active days a month; the days are bits of one number, so no row per day is kept to count them."""
    bit = F.expr("shiftleft(1, dayofmonth(date_from_unix_date(int(day))) - 1)")
    return cov.groupBy("vsn", "task", "bucket", month_of_day("day").alias("month")).agg(
        F.sum("n_uploads").alias("n_uploads"), F.bit_count(F.bit_or(bit)).cast("bigint").alias("active_days"))


PIVOT_NAMES = {"audio": "audio_clips", "image": "image_frames", "ptz": "ptz_frames",
               "derived": "other_media", "non_media": "non_media"}


def pivot_days(cov: DataFrame) -> DataFrame:
    """One row per (vsn, day), one column per bucket, missing buckets 0."""
    sums = [F.sum(F.when(F.col("bucket") == b, F.col("n_uploads")).otherwise(0)).cast("bigint")
            .alias(PIVOT_NAMES[b]) for b in ALL_BUCKETS]
    return cov.groupBy("vsn", "day").agg(*sums)


def pivot_uploads(uploads: DataFrame, time: str = "t", as_of_day: int | None = None) -> DataFrame:
    """pivot_days of the coverage of raw rows, counted at once: there is no row per task in between."""
    rows = uploads.select("vsn", "task", day_no(time).alias("day"), F.lit(1).cast("bigint").alias("n_uploads"))
    return pivot_days(classify(clean_daily(rows, as_of_day)))


def inventory(nodes: DataFrame, cov: DataFrame, first: DataFrame) -> DataFrame:
    """Nodes with deployment start and media and capture totals."""
    t = cov.groupBy("vsn").agg(
        F.sum(F.when(F.col("is_media"), F.col("n_uploads")).otherwise(0)).alias("media_uploads_total"),
        F.sum(F.when(F.col("is_capture"), F.col("n_uploads")).otherwise(0)).alias("capture_uploads_total"))
    x = nodes.join(first, "vsn", "left").join(t, "vsn", "left")
    return x.na.fill(0, ["media_uploads_total", "capture_uploads_total"])


def first_record(telemetry: DataFrame, metrics: list[str] = FIRST_RECORD_METRICS) -> DataFrame:
    """Earliest record per node, from the first preferred metric the node has, else any."""
    tries = [F.min(F.when(F.col("name") == m, F.col("t"))) for m in metrics]
    return telemetry.groupBy("vsn").agg(F.coalesce(*tries, F.min("t")).alias("first_t"))


def task_universe(uploads: DataFrame, sampled: Column) -> DataFrame:
    return uploads.where(sampled).select("task").distinct()


def node_only_tasks(uploads: DataFrame, sampled: Column, universe: DataFrame) -> DataFrame:
    """(vsn, task) seen in the node sample but missing from the fleet universe."""
    return uploads.where(sampled).select("vsn", "task").distinct().join(universe, "task", "left_anti")


def latest_record(telemetry: DataFrame, nodes: DataFrame, now: Column, short_us: int = 2 * DAY_US,
                  long_us: int = 14 * DAY_US) -> DataFrame:
    """Latest record per node and how recent it is; nodes with none are 'quiet'."""
    recent = telemetry.where((F.col("t") <= now) & (F.col("t") >= now - long_us))
    last = pick_first(recent, ["vsn"], ["t", "name"], [], descending=True)
    tier = F.when(F.col("t") >= now - short_us, "live").when(F.col("t").isNotNull(), "stale").otherwise("quiet")
    return nodes.select("vsn").join(last, "vsn", "left").withColumn("tier", tier)


def archive_census(uploads: DataFrame, by: list[str]) -> DataFrame:
    return uploads.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files")).orderBy(F.desc("n_files"), *by)


def latest_uploads(uploads: DataFrame, by: list[str], time: str, n: int, since: Column) -> DataFrame:
    """Last n uploads of each key in a trailing window, ascending.

    Rank-limited windows keep only n rows per key before the shuffle.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy(F.col(time).desc())
    x = uploads.where(F.col(time) >= since).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    return x.drop("__r").orderBy(*by, time)
