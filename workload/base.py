"""Query registry, table loading and the stand-in columns shared by Spark and SQL.

The driver's tables are commerce-shaped. Positions come from ids by integer arithmetic
that both engines evaluate alike; times are integer microseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlens.functions.timecols import micros
from stormlens.session import ship
from stormlens.sources.tables import balanced

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR
MINUTE = 60_000_000


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    ship(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return balanced(df) if spread else df


def lat_of(c: str, m: int = 37) -> Column:
    return F.lit(35.0) + (F.col(c) * m % 997) / F.lit(1000.0)


def lon_of(c: str, m: int = 91) -> Column:
    return F.lit(-120.0) + (F.col(c) * m % 1499) / F.lit(1000.0)


def nodes(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("vsn"), lat_of("s_suppkey").alias("n_lat"),
                    lon_of("s_suppkey").alias("n_lon"), F.col("s_nationkey").alias("nation"),
                    F.col("s_acctbal").alias("bal"))


NODES = """nodes AS (SELECT s_suppkey AS vsn, 35.0::DOUBLE + (s_suppkey*37 % 997)/1000.0::DOUBLE AS n_lat,
  -120.0::DOUBLE + (s_suppkey*91 % 1499)/1000.0::DOUBLE AS n_lon, s_nationkey AS nation, s_acctbal AS bal
  FROM supplier)"""


def fires(spark, sf) -> DataFrame:
    """Customers with orders: discovery = last order, size = largest order."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max(micros("o_orderdate")).alias("discovery"), F.max("o_totalprice").alias("size_acres"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_custkey").alias("fire_id"), lat_of("c_custkey").alias("f_lat"),
        lon_of("c_custkey").alias("f_lon"), "discovery", "size_acres",
        F.col("c_mktsegment").alias("cause"), F.col("c_nationkey").alias("nation"))


FIRES = """fires AS (SELECT c_custkey AS fire_id, 35.0::DOUBLE + (c_custkey*37 % 997)/1000.0::DOUBLE AS f_lat,
  -120.0::DOUBLE + (c_custkey*91 % 1499)/1000.0::DOUBLE AS f_lon, discovery, size_acres, c_mktsegment AS cause,
  c_nationkey AS nation
  FROM customer JOIN (SELECT o_custkey, max(epoch_us(o_orderdate)) AS discovery, max(o_totalprice) AS size_acres
    FROM orders GROUP BY 1) o ON o_custkey = c_custkey)"""


def flashes(spark, sf, good: bool = True) -> DataFrame:
    """Flashes; quality 0 (the kept ones) is return flag A."""
    l = table(spark, sf, "lineitem", spread=True)
    if good:
        l = l.where("l_returnflag = 'A'")
    return l.select((micros("l_shipdate") + F.col("l_orderkey") % 24 * HOUR).alias("t"), lat_of("l_partkey", 53).alias("lat"),
                    lon_of("l_partkey", 71).alias("lon"), F.col("l_extendedprice").alias("energy"),
                    F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("quality"),
                    (F.col("l_suppkey") % 4 + 16).alias("sat"), F.col("l_suppkey").alias("vsn"))


FLASHES = """flashes AS (SELECT epoch_us(l_shipdate) + l_orderkey % 24 * 3600000000 AS t,
  35.0::DOUBLE + (l_partkey*53 % 997)/1000.0::DOUBLE AS lat,
  -120.0::DOUBLE + (l_partkey*71 % 1499)/1000.0::DOUBLE AS lon, l_extendedprice AS energy,
  0 AS quality, l_suppkey % 4 + 16 AS sat, l_suppkey AS vsn
  FROM lineitem WHERE l_returnflag = 'A')"""


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", micros("ts").alias("t"), F.col("user_id").alias("vsn"),
        F.col("event_type").alias("name"), "value",
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"))


EVENTS = """ev AS (SELECT event_id, epoch_us(ts) AS t, user_id AS vsn, event_type AS name, value,
  CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events)"""


def hav(a: str, b: str, c: str, d: str) -> str:
    """SQL text of the great-circle distance in km."""
    h = (f"(power(sin((radians({c})-radians({a}))/2),2) + cos(radians({a}))*cos(radians({c}))"
         f"*power(sin((radians({d})-radians({b}))/2),2))")
    return f"(2*6371.0088*asin(sqrt(greatest(least({h},1.0),0.0))))"


def planar(a: str, b: str, c: str, d: str) -> str:
    """SQL text of the flat-earth distance in km, cosine at the first point."""
    return (f"(sqrt(power(({d}-{b})*111320.0*cos(radians({a})),2)+power(({c}-{a})*110540.0,2))/1000.0)")


def day_sql(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%d')"


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def uploads(spark, sf) -> DataFrame:
    """Archive rows: one per lineitem, the task named by its flags."""
    l = table(spark, sf, "lineitem")
    kind = F.concat("l_returnflag", "l_linestatus")
    task = F.when(F.col("l_linenumber") == 7, "status-report")
    for k, name in TASKS.items():
        task = task.when(kind == k, name)
    return l.select(F.col("l_suppkey").alias("vsn"), micros("l_shipdate").alias("t"),
                    task.otherwise("other").alias("task"))


TASKS = {"AF": "AudioSampler", "AO": "audio-sampler", "NF": "imagesampler-top", "NO": "fast-image-sampler",
         "RF": "ptz-yolo", "RO": "smoke-detector-cam"}

UPLOADS = ("up AS (SELECT l_suppkey AS vsn, epoch_us(l_shipdate) AS t, CASE WHEN l_linenumber = 7 THEN 'status-report' "
           + " ".join(f"WHEN l_returnflag || l_linestatus = '{k}' THEN '{v}'" for k, v in TASKS.items())
           + " ELSE 'other' END AS task FROM lineitem)")

BUCKET_SQL = """CASE WHEN regexp_matches(task, '(?i)audio-?sampler') THEN 'audio'
  WHEN regexp_matches(task, '(?i)(fast-)?image-?sampler') THEN 'image' WHEN regexp_matches(task, '(?i)ptz-yolo') THEN 'ptz'
  WHEN regexp_matches(task, '(?i)smoke-detector|yolo') THEN 'derived' ELSE 'non_media' END"""

COVERAGE = f"""{UPLOADS}, cov AS (SELECT vsn, task, t // {DAY} AS day, count(*) AS n_uploads, {BUCKET_SQL} AS bucket
  FROM up GROUP BY ALL)"""


def rain(spark, sf) -> DataFrame:
    """Hourly cumulative gauge per node: the running sum of l_quantity."""
    from stormlens.operators.blocks import with_block, with_carry, key_window
    from pyspark.sql import Window
    l = table(spark, sf, "lineitem")
    h = l.groupBy(F.col("l_suppkey").alias("vsn"),
                  (micros("l_shipdate") + F.col("l_orderkey") % 24 * HOUR).alias("hour")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("inc"))
    x = with_carry(with_block(h, "hour", 60 * DAY), ["vsn"], {"c": (F.sum("inc"), "sum")})
    w = key_window(["vsn"], "__block").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    hi = F.sum("inc").over(w) + F.coalesce("c", F.lit(0))
    return x.select("vsn", "hour", (hi - F.col("inc")).cast("double").alias("lo"), hi.cast("double").alias("hi"))


RAIN = """rain AS (SELECT vsn, hour, (hi - inc)::DOUBLE AS lo, hi::DOUBLE AS hi FROM (SELECT vsn, hour, inc,
  sum(inc) OVER (PARTITION BY vsn ORDER BY hour) AS hi FROM (SELECT l_suppkey AS vsn,
   epoch_us(l_shipdate) + l_orderkey % 24 * 3600000000 AS hour, sum(l_quantity::BIGINT) AS inc
   FROM lineitem GROUP BY 1, 2)))"""
