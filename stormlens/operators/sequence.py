"""Sessions, greedy groups, robust spikes, hysteresis events and subsampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlens.operators.blocks import (BLOCK, key_window, map_sorted_groups, neighbours,
                                        row_numbers, with_block)
from stormlens.operators.joins import asof_backward
from stormlens.operators.quantiles import exact_quantile
from stormlens.session import cut


def episodes(df: DataFrame, by: list[str], time: str, gap, block=None,
             keep_min: dict[str, Column] | None = None) -> DataFrame:
    """Gap sessions: a new one starts where the gap is strictly larger than `gap`.

    Sessions are built inside (key, block) first; only these partial sessions, whose
    number depends on the time span, are merged per key. `keep_min` adds columns that hold
    the minimum of an expression over the session.
    Output: by, episode_start, episode_end, n, keep_min columns.
    """
    extra = keep_min or {}
    length = block or gap * 8
    x = with_block(df.select(*by, time, *[c.alias(n) for n, c in extra.items()]), time, length)
    w = key_window(by, BLOCK).orderBy(time)
    before = F.lag(time).over(w)
    x = x.withColumn("__new", (before.isNull() | (F.col(time) - before > gap)).cast("bigint"))
    x = x.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    partial = x.groupBy(*by, BLOCK, "__i").agg(
        F.min(time).alias("__s"), F.max(time).alias("__e"), F.count(F.lit(1)).alias("__n"),
        *[F.min(n).alias(n) for n in extra])
    return merge_sessions(partial, by, gap, list(extra))


def merge_sessions(partial: DataFrame, by: list[str], gap, keep_min: list[str]) -> DataFrame:
    """Gap sessions of a key from sessions (__s, __e, __n, keep_min) of parts of its rows, however the parts overlap."""
    before = key_window(by).orderBy("__s")
    prev_end = F.max("__e").over(before.rowsBetween(Window.unboundedPreceding, -1))
    partial = partial.withColumn(
        "__brk", (prev_end.isNull() | (F.col("__s") - prev_end > gap)).cast("bigint"))
    partial = partial.withColumn("__g", F.sum("__brk").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return partial.groupBy(*by, "__g").agg(
        F.min("__s").alias("episode_start"), F.max("__e").alias("episode_end"),
        F.sum("__n").alias("n"), *[F.min(n).alias(n) for n in keep_min]).drop("__g")


def episode_summary(eps: DataFrame, by: list[str], keep_min: list[str] | None = None) -> DataFrame:
    """Number of episodes, first start, end and size of the last episode."""
    last = F.max(F.struct("episode_end", "n"))
    return eps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_episodes"), F.min("episode_start").alias("first_time"),
        last["episode_end"].alias("last_end"), last["n"].alias("last_n"),
        F.sum("n").alias("n_total"), *[F.min(n).alias(n) for n in keep_min or []])


# ---------------------------------------------------------------- greedy groups

def _next_uncovered(t: np.ndarray, width, strict: bool) -> np.ndarray:
    """Index of the first event not covered by a group that starts at each event."""
    return np.searchsorted(t, t + width, side="left" if strict else "right")


def _transfer(t: np.ndarray, width, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """How sorted times map the last group start before them to the last start among them.

    Only events within `width` of the first can be covered from before, so the map has one
    step per such event: (entry times, last start of the chain that begins there).
    """
    nxt = _next_uncovered(t, width, strict).tolist()
    last = list(range(len(t)))
    for i in range(len(t) - 1, -1, -1):
        if nxt[i] < len(t):
            last[i] = last[nxt[i]]
    head = min(int(np.searchsorted(t, t[0] + width, side="right")) + 1, len(t))
    return t[:head], t[last[:head]]


def _starts(t: np.ndarray, carried, width, strict: bool) -> np.ndarray:
    """Group start of every event of one block, given the last start before the block."""
    out = np.empty_like(t)
    i = 0
    if carried is not None:
        i = int(np.searchsorted(t, carried + width, side="left" if strict else "right"))
        out[:i] = carried
    nxt = _next_uncovered(t, width, strict)
    while i < len(t):
        out[i:nxt[i]] = t[i]
        i = nxt[i]
    return out


#: Blocks whose maps are composed in one row.
FAN_IN = 16


def _entering(blocks: DataFrame, by: list[str], tname: str, width, strict: bool) -> DataFrame:
    """(by, BLOCK, __in): the last start before each block, by composing block maps in a tree.

    blocks: by, BLOCK, entries, exits: a start `last` before the block leads to the exit of the
    first entry beyond last + width, to itself if there is none. Going up, the maps of FAN_IN
    neighbours become one; going down, each node hands its children what enters them. A start
    before some blocks never reaches beyond the first of them, so a composed map needs the
    entries of its first block and one more; entries that lead to the same exit are one.
    """
    def lead(last, m):
        limit = last + F.lit(width)
        free = F.filter(F.arrays_zip(m["entries"].alias("e"), m["exits"].alias("x")),
                        lambda z: last.isNull() | ((z["e"] >= limit) if strict else (z["e"] > limit)))
        return F.coalesce(F.get(free, F.lit(0))["x"], last)

    def distinct_exits(m):
        keep = F.filter(F.sequence(F.lit(0), F.size(m["exits"]) - 1),
                        lambda i: F.coalesce(F.get(m["exits"], i + 1) != F.get(m["exits"], i), F.lit(True)))
        return F.struct(F.transform(keep, lambda i: F.get(m["entries"], i)).alias("entries"),
                        F.transform(keep, lambda i: F.get(m["exits"], i)).alias("exits"))

    def compose(f, g):
        ends = F.transform(f["exits"], lambda x: lead(x, g))
        return distinct_exits(F.struct(F.concat(f["entries"], F.slice(g["entries"], 1, F.lit(1))).alias("entries"),
                                       F.concat(ends, F.slice(g["exits"], 1, F.lit(1))).alias("exits")))

    lo, hi = blocks.agg(F.min(BLOCK), F.max(BLOCK)).first()
    node = blocks.select(*by, (F.col(BLOCK) - F.lit(lo or 0)).alias("at"),
                         distinct_exits(F.struct("entries", "exits")).alias("m"))
    levels = []
    top = (hi or 0) - (lo or 0)
    while True:
        family = cut(node.groupBy(*by, F.floor(F.col("at") / FAN_IN).alias("parent")).agg(
            F.array_sort(F.collect_list(F.struct("at", "m"))).alias("c")))
        levels.append(family)
        top //= FAN_IN
        if top <= 0:
            break
        whole = F.aggregate(F.slice("c", 2, F.lit(FAN_IN)), F.col("c")[0]["m"], lambda f, g: compose(f, g["m"]))
        node = family.select(*by, F.col("parent").alias("at"), whole.alias("m"))

    def step(acc, c):
        done = F.concat(acc["done"], F.array(F.struct(c["at"].alias("at"), acc["last"].alias("s"))))
        return F.struct(lead(acc["last"], c["m"]).alias("last"), done.alias("done"))

    state = None
    for family in reversed(levels):
        x = family.withColumn("s", F.lit(None).cast(tname)) if state is None else family.join(state, [*by, "parent"])
        zero = F.struct(F.col("s").alias("last"), F.array().cast(f"array<struct<at:bigint,s:{tname}>>").alias("done"))
        state = x.select(*by, F.explode(F.aggregate("c", zero, step)["done"]).alias("d")).select(
            *by, F.col("d.at").alias("parent"), F.col("d.s").alias("s"))
    return state.select(*by, (F.col("parent") + F.lit(lo or 0)).alias(BLOCK), F.col("s").alias("__in"))


def greedy_groups(df: DataFrame, by: list[str], time: str, width, *, block, strict: bool = False,
                  out: str = "group_start") -> DataFrame:
    """Greedy grouping against the group's first time (not the previous event).

    An event joins while time - group start <= width (< width if `strict`). The rule is
    sequential, so each (key, block) is summarised as a map from "last start before me" to
    "last start in me"; the maps are composed in a tree over blocks, then every block is
    assigned on its own. `time` must be an integer or double column, `block` > width.
    """
    if block <= width:
        raise ValueError("block must be longer than width")
    ttype = df.schema[time].dataType
    tname = ttype.simpleString()
    keys = df.select(*by).schema.fields
    k = [*by, BLOCK]
    x = with_block(df, time, block)

    def summarise(pdf, cuts):
        parts = [_transfer(t, width, strict) for t in np.split(pdf[time].to_numpy(), cuts)]
        head = pdf.iloc[np.r_[0, cuts]][k].reset_index(drop=True)
        ends = np.r_[cuts, len(pdf)] - 1
        return head.assign(entries=[p[0] for p in parts], exits=[p[1] for p in parts],
                           t_last=pdf[time].to_numpy()[ends])

    blocks = map_sorted_groups(x.select(*k, time), k, [time], summarise, T.StructType([
        *keys, T.StructField(BLOCK, T.LongType()), T.StructField("entries", T.ArrayType(ttype)),
        T.StructField("exits", T.ArrayType(ttype)), T.StructField("t_last", ttype)]))

    entering = _entering(cut(blocks), by, tname, width, strict)

    def assign(pdf, cuts):
        carried = pdf["__in"].to_numpy()[np.r_[0, cuts]]
        parts = [_starts(t, None if pd.isna(c) else c, width, strict)
                 for t, c in zip(np.split(pdf[time].to_numpy(), cuts), carried)]
        return pdf.drop(columns=["__in"]).assign(__start=np.concatenate(parts))

    y = x.join(entering, k)
    if isinstance(ttype, T.LongType):
        # keep integer times exact: a null would turn the column into doubles
        y = y.withColumn("__in", F.coalesce("__in", F.lit(-(2**62))))
    done = map_sorted_groups(y, k, [time], assign, T.StructType([
        *[f for f in y.schema.fields if f.name != "__in"], T.StructField("__start", ttype)]))
    return done.drop(BLOCK).withColumnRenamed("__start", out)


def greedy_dedupe(df: DataFrame, by: list[str], time: str, min_sep, *, block,
                  nearest: str | None = None) -> DataFrame:
    """Drop items less than `min_sep` after the last kept one.

    Kept: the earliest time; if `nearest` is given, the smallest value seen in the group.
    """
    g = greedy_groups(df, by, time, min_sep, block=block, strict=True, out="__g")
    aggs = [F.count(F.lit(1)).alias("n_merged")]
    if nearest:
        aggs.append(F.min(nearest).alias(nearest))
    return g.groupBy(*by, F.col("__g").alias(time)).agg(*aggs)


# ---------------------------------------------------------------- robust spikes

def _middle(items: list[Column]) -> Column:
    return F.array_sort(F.array(*items))[len(items) // 2]


def robust_spikes(df: DataFrame, by: list[str], order: str, value: str, *, block,
                  z: float = 4.0, min_jump: float = 8.0, sparse_after=3.0, day_level: float = 90.0,
                  latency: float = 0.2) -> DataFrame:
    """Spikes above a rolling-median baseline with edges replicated, plus event features.

    Baseline width is 7 (5 for series of 5 or 6 rows; shorter series give none). A spike has
    robust z > `z` and rises more than `min_jump` over the baseline. Features: gap to the
    nearer neighbour, median of up to three neighbours on each side (itself excluded),
    jump, sparse-cadence and daytime flags, timing sigma.
    `sparse_after` is in units of `order`, which must be unique per key.
    """
    x = neighbours(with_block(df, order, block), by, order, value, 3)
    x = x.where(F.col("__n") >= 5)

    def side(arr, i, edge):
        return F.coalesce(F.get(F.col(arr), F.lit(i))["v"], F.col(edge))

    v = F.col(value)
    p = [side("__prev", i, "__first") for i in range(3)]
    n = [side("__next", i, "__last") for i in range(3)]
    baseline = F.when(F.col("__n") >= 7, _middle([p[2], p[1], p[0], v, n[0], n[1], n[2]])).otherwise(
        _middle([p[1], p[0], v, n[0], n[1]]))
    prev_gap = F.col(order) - F.get("__prev", F.lit(0))["t"]
    next_gap = F.get("__next", F.lit(0))["t"] - F.col(order)
    around = F.array_sort(F.concat(F.transform("__prev", lambda s: s["v"]),
                                   F.transform("__next", lambda s: s["v"])))
    k = F.size(around)
    local = (F.get(around, F.floor((k - 1) / 2).cast("int"))
             + F.get(around, F.floor(k / 2).cast("int"))) / 2
    x = cut(x.select(*df.columns, (v - baseline).alias("__d"),
                     F.least(prev_gap, next_gap).alias("min_gap"), local.alias("local_base")))
    med = exact_quantile(x, by, "__d", 0.5, "__med")
    x = x.join(med, by) if by else x.withColumn("__med", med.select("__med").scalar())
    dev = x.select(*by, F.abs(F.col("__d") - F.col("__med")).alias("__a"))
    mad = exact_quantile(dev, by, "__a", 0.5, "__mad")
    x = x.join(mad, by) if by else x.withColumn("__mad", mad.select("__mad").scalar())
    score = F.lit(0.6745) * (F.col("__d") - F.col("__med")) / (F.col("__mad") + 1e-12)
    hit = x.where((score > z) & (F.col("__d") > min_jump))
    return hit.select(
        *df.columns, F.col("__d").alias("rise"), score.alias("z"), "min_gap", "local_base",
        (v - F.col("local_base")).alias("jump"),
        (F.col("min_gap") > sparse_after).alias("sparse"),
        (F.col("local_base") > day_level).alias("daytime"),
        F.lit(0.6 / 2 + latency).alias("sigma_s"))


def flash_anchors(spikes: DataFrame, include_daytime: bool = False) -> DataFrame:
    return spikes if include_daytime else spikes.where(~F.col("daytime"))


def calm_neighbour(df: DataFrame, by: list[str], order: str, spike: str, *, block,
                   out: str = "base_order") -> DataFrame:
    """Nearest non-spike frame in the order one back, one ahead, two back, two ahead."""
    x = neighbours(with_block(df, order, block), by, order, spike, 2)

    def calm(arr, i):
        near = F.get(F.col(arr), F.lit(i))
        return F.when(~near["v"], near["t"])
    picked = F.coalesce(calm("__prev", 0), calm("__next", 0), calm("__prev", 1), calm("__next", 1))
    return x.select(*df.columns, picked.alias(out))


# ---------------------------------------------------------------- hysteresis

def hysteresis_islands(df: DataFrame, by: list[str], order: str, value: str, *, on: float,
                       off: float, block) -> DataFrame:
    """Events that open at value >= on and close at the first value < off.

    The closing row belongs to the event; an event still open at the end closes there.
    Each block is summarised by its first and last marker and its last certain start, so
    open state and start are carried over blocks in one pass.
    Output: by, start, end (values of `order`), n.
    """
    t, v = F.col(order), F.col(value)
    m = F.when(v >= on, 1).when(v < off, 0)
    x = with_block(df.select(*by, order, m.alias("__m")), order, block)
    w = key_window(by, BLOCK).orderBy(order)
    local = F.last("__m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("__was", local)
    mark = F.when(F.col("__m").isNotNull(), F.struct(t.alias("t"), F.col("__m").alias("m")))
    per = x.groupBy(*by, BLOCK).agg(
        F.min(mark).alias("a"), F.max(mark).alias("z"),
        F.max(F.when((F.col("__m") == 1) & (F.col("__was") == 0), t)).alias("sure"))
    seq = key_window(by).orderBy(BLOCK)
    before = seq.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__open_in", F.coalesce(F.last("z", ignorenulls=True).over(before)["m"], F.lit(0)))
    first_opens = F.when((F.col("a.m") == 1) & (F.col("__open_in") == 0), F.col("a.t"))
    per = per.withColumn("last_start", F.coalesce("sure", first_opens))
    per = per.select(*by, BLOCK, "__open_in",
                     F.last("last_start", ignorenulls=True).over(before).alias("__start_in"))
    x = x.join(per, [*by, BLOCK])
    was = F.coalesce(F.col("__was"), F.col("__open_in"))
    opens = F.coalesce((F.col("__m") == 1) & (was == 0), F.lit(False))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__o", F.when(opens, t)).withColumn("__inside", opens | (was == 1))
    x = x.withColumn("start", F.coalesce(F.last("__o", ignorenulls=True).over(upto), F.col("__start_in")))
    return x.where(F.col("__inside")).groupBy(*by, "start").agg(
        F.max(order).alias("end"), F.count(F.lit(1)).alias("n"))


def merge_intervals(ev: DataFrame, by: list[str], min_gap, start: str = "start", end: str = "end",
                    block=None) -> DataFrame:
    """Join disjoint events whose start lies less than `min_gap` after the previous end."""
    x = cut(with_block(ev.select(*by, start, end), start, block or min_gap * 64))
    w = key_window(by, BLOCK).orderBy(start)
    x = x.withColumn("__pe", F.lag(end).over(w))
    sure = F.when(F.col(start) - F.col("__pe") >= min_gap, F.col(start))
    per = x.groupBy(*by, BLOCK).agg(F.min(start).alias("a"), F.max(end).alias("z"), F.max(sure).alias("sure"))
    seq = key_window(by).orderBy(BLOCK)
    per = per.withColumn("__pe_in", F.lag("z").over(seq))
    first = F.when(F.col("__pe_in").isNull() | (F.col("a") - F.col("__pe_in") >= min_gap), F.col("a"))
    per = per.withColumn("last_start", F.coalesce("sure", first)).select(
        *by, BLOCK, "__pe_in", F.last("last_start", ignorenulls=True).over(
            seq.rowsBetween(Window.unboundedPreceding, -1)).alias("__ms_in"))
    x = x.join(per, [*by, BLOCK])
    pe = F.coalesce("__pe", "__pe_in")
    x = x.withColumn("__b", F.when(pe.isNull() | (F.col(start) - pe >= min_gap), F.col(start)))
    group = F.coalesce(F.last("__b", ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)), F.col("__ms_in"))
    return x.select(*by, group.alias("__g"), end).groupBy(*by, F.col("__g").alias("start")).agg(
        F.max(end).alias("end"), F.count(F.lit(1)).alias("n_islands"))


def event_shape(frames: DataFrame, events: DataFrame, by: list[str], order: str, value: str, *,
                hop, block, index: str, low: str | None = None, mid: str | None = None,
                raw_low: str | None = None, raw_mid: str | None = None) -> DataFrame:
    """Duration, peak, mean, rise, decay and band shares of each event.

    `index` numbers the frames of a key consecutively. Rise runs from the first frame at or
    above half the peak to the first peak frame, decay from there to the last such frame.
    """
    keep = [c for c in dict.fromkeys([index, value, low, mid, raw_low, raw_mid]) if c]
    events = cut(events.select(*by, "start", "end"))
    base = frames.select(*by, F.col(order).alias("__o"), *keep)
    rows = asof_backward(base, events, by, "__o", "start", ["end"], block=block)
    # read twice below: once for the peak, once for the half-peak edges
    rows = cut(rows.where(F.col("start").isNotNull() & (F.col("__o") <= F.col("end"))))
    key = [*by, "start", "end"]
    # first frame of the maximum: largest value, then smallest index
    top = F.max(F.struct(F.col(value).alias("v"), (-F.col(index)).alias("ni")))
    sums = [F.count(F.lit(1)).alias("n_frames"), F.avg(value).alias("mean"), top.alias("__top")]
    if low and mid:
        sums += [F.sum(low).alias("__low"), F.sum(mid).alias("__mid")]
    if raw_low and raw_mid:
        sums += [F.avg(F.col(raw_low) - F.col(raw_mid)).alias("sub_over_mid")]
    per = rows.groupBy(*key).agg(*sums)
    half = F.col(value) >= F.col("__pk") / 2
    edges = rows.join(per.select(*key, F.col("__top.v").alias("__pk")), key).groupBy(*key).agg(
        F.min(F.when(half, F.col(index))).alias("__a"), F.max(F.when(half, F.col(index))).alias("__b"))
    x = per.join(edges, key)
    pk = -F.col("__top.ni")
    cols = [
        *key, "n_frames", (F.col("n_frames") * F.lit(hop)).alias("duration"),
        F.col("__top.v").alias("peak"), "mean",
        F.greatest((pk - F.col("__a")) * F.lit(hop), F.lit(hop)).alias("rise"),
        F.greatest((F.col("__b") - pk) * F.lit(hop), F.lit(hop * 0)).alias("decay"),
    ]
    if low and mid:
        cols.append((F.col("__mid") / (F.col("__low") + F.col("__mid") + 1e-9)).alias("mid_fraction"))
    if raw_low and raw_mid:
        cols.append("sub_over_mid")
    return x.select(*cols)


# ---------------------------------------------------------------- sampling by rank

def even_subsample(df: DataFrame, by: list[str], order: list[str], cap: int, *, block_on: str,
                   block) -> DataFrame:
    """At most `cap` rows per key, evenly spread: positions floor(i * n / cap)."""
    x = row_numbers(df, by, order, block_on, block, out="__rn", total="__n")
    pos = F.col("__rn") - 1
    # pos is picked when some i in [0, cap) has floor(i * n / cap) = pos
    i = F.floor((pos * cap + F.col("__n") - 1) / F.col("__n"))
    picked = (F.col("__n") <= cap) | ((i < cap) & (F.floor(i * F.col("__n") / cap) == pos))
    return x.where(picked).drop("__rn", "__n")


def filmstrip(df: DataFrame, by: list[str], order: list[str], k: int, *, block_on: str, block
              ) -> DataFrame:
    """Every max(n // k, 1)-th row, the first k of them."""
    x = row_numbers(df, by, order, block_on, block, out="__rn", total="__n")
    every = F.greatest(F.floor(F.col("__n") / k), F.lit(1))
    pos = F.col("__rn") - 1
    return x.where((pos % every == 0) & (pos / every < k)).drop("__rn", "__n")
