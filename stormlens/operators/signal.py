"""Audio clips and images held as arrays or image-source rows.

A clip or a frame is one bounded row. Envelopes, onsets and ratios stay JVM-side; the
short-time spectrum and pixel statistics are Arrow batches of numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlens.functions.geo import _c
from stormlens.operators.detect import DetectorConfig
from stormlens.operators.quantiles import exact_quantile
from stormlens.session import cut

# Guard inside logarithms, spectral floor, analysis bands in Hz.
EPS = 1e-12
PSD_EPS = 1e-14
BAND = (15.0, 200.0)
SUB_BAND = (15.0, 60.0)
MID_BAND = (60.0, 200.0)
THUNDER_BAND = (20.0, 150.0)


# ---------------------------------------------------------------- arrays, JVM-side

def mono(channels) -> Column:
    """Mean over channels of array<array<float>>."""
    n = F.size(_c(channels))
    first = F.transform(F.get(_c(channels), F.lit(0)), lambda x: x.cast("double"))
    total = F.aggregate(F.slice(_c(channels), 2, F.greatest(n - 1, F.lit(0))), first,
                        lambda acc, ch: F.zip_with(acc, ch, lambda a, b: a + b))
    return F.transform(total, lambda x: x / n)


def _hops(y, hop: int) -> np.ndarray:
    """RMS of each full hop of one clip; empty if there is none."""
    if y is None:
        return np.zeros(0)
    y = np.asarray(y, float)
    n = len(y) // hop
    return np.sqrt((y[:n * hop].reshape(n, hop) ** 2).mean(axis=1)) if n else np.zeros(0)


def _per_clip(fn, kind: str, samples) -> Column:
    """`fn` of each clip, batch by batch: an array is read once however long it is."""
    def run(clips: pd.Series) -> pd.Series:
        return pd.Series([fn(y) for y in clips], dtype=object)
    return F.pandas_udf(run, kind)(_c(samples))


def hop_rms(samples, hop: int) -> Column:
    """RMS of each full hop; null for a clip shorter than one."""
    return _per_clip(lambda y: r if len(r := _hops(y, hop)) else None, "array<double>", samples)


def envelope_db(samples, hop: int) -> Column:
    """dB level per hop; a clip shorter than one hop gives a single -120."""
    return _per_clip(lambda y: 20.0 * np.log10(r + EPS) if len(r := _hops(y, hop)) else np.array([-120.0]), "array<double>", samples)


def leading_edge(d, k_db: float = 8.0, sustain: int = 4) -> int | None:
    """First hop from which `sustain` hops in a row exceed the 20th percentile by k_db, walked back
    while 3 dB above it. The last start looked at is one short of the last possible."""
    if d is None or len(d) < sustain + 2:
        return None
    d = np.asarray(d, float)
    floor = np.quantile(d, 0.2)
    loud = np.concatenate([[0], np.cumsum(d > floor + k_db)])
    starts = np.flatnonzero(loud[sustain:-1] - loud[:-1 - sustain] == sustain)
    if not len(starts):
        return None
    quiet = np.flatnonzero(~(d[:starts[0]] > floor + 3.0))
    return int(quiet[-1]) + 1 if len(quiet) else 0


def onset_hop(db, k_db: float = 8.0, sustain: int = 4) -> Column:
    """Hop index of the leading edge, or null; see `leading_edge`."""
    return _per_clip(lambda d: leading_edge(d, k_db, sustain), "int", db)


def onset_time(db, hop_s: float, **kw) -> Column:
    return onset_hop(db, **kw) * F.lit(hop_s) + F.lit(hop_s / 2)


def peak_over_median(samples, window: int, min_windows: int = 4) -> Column:
    """Loudest window over the median window (RMS); 0 for clips with too few windows."""
    def ratio(y):
        e = _hops(y, window)
        return 0.0 if len(e) < min_windows else float(e.max() / (np.median(e) + 1e-9))
    return _per_clip(ratio, "double", samples)


# ---------------------------------------------------------------- spectra

def _tapered(n: int, share: float = 0.25) -> np.ndarray:
    """Tapered-cosine (Tukey) window, periodic form, as used for density spectra."""
    x = np.arange(n) / n
    edge = np.minimum(x, 1 - x) / (share / 2)
    return np.where(edge < 1, 0.5 * (1 - np.cos(np.pi * edge)), 1.0)


def density_db(y: np.ndarray, sr: float, nper: int, hop: int):
    """(frame times, frequencies, dB power density frames x bins) with the mean of each frame removed."""
    frames = np.lib.stride_tricks.sliding_window_view(y.astype(np.float64), nper)[::hop]
    w = _tapered(nper)
    spec = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2
    spec /= sr * (w * w).sum()
    spec[:, 1:(-1 if nper % 2 == 0 else None)] *= 2
    t = (np.arange(len(frames)) * hop + nper / 2) / sr
    return t, np.fft.rfftfreq(nper, 1 / sr), 10 * np.log10(spec + PSD_EPS)


def spectral_frames(clips: DataFrame, by: list[str], samples: str, sr: str,
                    cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Long spectrum (by, frame_idx, t, bin, f, db), only bins inside the analysis band.

    Clips shorter than one window give no rows.
    """
    schema = T.StructType([
        *clips.select(*by).schema.fields, T.StructField("frame_idx", T.IntegerType()),
        T.StructField("t", T.DoubleType()), T.StructField("bin", T.IntegerType()),
        T.StructField("f", T.DoubleType()), T.StructField("db", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                y, rate = np.asarray(getattr(row, samples)), int(getattr(row, sr))
                nper, hop = max(256, int(cfg.nperseg_s * rate)), max(64, int(cfg.hop_s * rate))
                if len(y) < nper:
                    continue
                t, f, db = density_db(y, rate, nper, hop)
                keep = np.flatnonzero((f >= BAND[0]) & (f <= BAND[1]))
                n, m = len(t), len(keep)
                yield pd.DataFrame({
                    **{c: [getattr(row, c)] * (n * m) for c in by},
                    "frame_idx": np.repeat(np.arange(n), m), "t": np.repeat(t, m),
                    "bin": np.tile(keep, n), "f": np.tile(f[keep], n), "db": db[:, keep].ravel()})

    return clips.select(*by, samples, sr).mapInPandas(run, schema)


def whitened_excess(spec: DataFrame, by: list[str], frame: str, *, bin_col: str = "bin", freq: str = "f",
                    db: str = "db", keep: list[str] | None = None, cfg: DetectorConfig = DetectorConfig()
                    ) -> DataFrame:
    """dB above each bin's stationary floor (20th percentile over frames, plus a margin),
    averaged over the bands, and raw band levels, per (by, frame)."""
    spec = cut(spec)
    floor = exact_quantile(spec, [*by, bin_col], db, cfg.floor_pct / 100.0, "__floor")
    x = spec.join(floor, [*by, bin_col])
    exc = F.greatest(F.lit(0.0), F.col(db) - F.col("__floor") - cfg.excess_margin_db)
    f = F.col(freq)

    def band_mean(v, b):
        return F.coalesce(F.avg(F.when(f.between(*b), v)), F.lit(0.0))
    return x.groupBy(*by, frame, *(keep or [])).agg(
        band_mean(exc, BAND).alias("exc"), band_mean(exc, SUB_BAND).alias("sub"),
        band_mean(exc, MID_BAND).alias("mid"), band_mean(F.col(db), SUB_BAND).alias("raw_sub"),
        band_mean(F.col(db), MID_BAND).alias("raw_mid"))


def clip_features(clips: DataFrame, samples: str, sr: str, hop_s: float = 0.02) -> DataFrame:
    """rms_db, peak_db, low_peak_db, low_ratio and duration_s per clip.

    The low band is taken on Fourier bins; its share uses Welch-averaged power density.
    """
    fields = ["rms_db", "peak_db", "low_peak_db", "low_ratio", "duration_s"]

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in fields]))
    def features(ys: pd.Series, rates: pd.Series) -> pd.DataFrame:
        rows = []
        for y, rate in zip(ys, rates):
            y = np.asarray(y, dtype=np.float64)
            hop = max(int(rate * hop_s), 1)

            def levels(x):
                n = len(x) // hop
                if not n:
                    return np.array([-120.0])
                return 20 * np.log10(np.sqrt((x[:n * hop].reshape(n, hop) ** 2).mean(axis=1)) + EPS)
            spec, f = np.fft.rfft(y), np.fft.rfftfreq(len(y), 1 / rate)
            low = np.fft.irfft(np.where((f >= THUNDER_BAND[0]) & (f <= THUNDER_BAND[1]), spec, 0), len(y))
            ratio = 0.0
            if len(y) >= rate // 4:
                nper = min(4096, len(y))
                part = np.lib.stride_tricks.sliding_window_view(y, nper)[::max(nper // 2, 1)]
                w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(nper) / nper))
                p = (np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2).mean(axis=0)
                p[1:(-1 if nper % 2 == 0 else None)] *= 2
                g = np.fft.rfftfreq(nper, 1 / rate)
                m = (g >= THUNDER_BAND[0]) & (g <= THUNDER_BAND[1])
                ratio = float(np.trapezoid(p[m], g[m]) / (np.trapezoid(p, g) + EPS))
            rows.append((20 * np.log10(np.sqrt((y ** 2).mean()) + EPS), levels(y).max(), levels(low).max(),
                         ratio, len(y) / rate))
        return pd.DataFrame(rows, columns=fields)

    rest = [c for c in clips.columns if c != samples]
    return clips.select(*rest, features(samples, sr).alias("__f")).select(*rest, "__f.*")


# ---------------------------------------------------------------- images

def image_stats(images: DataFrame, image: str = "image", thumb: int = 96) -> DataFrame:
    """Luma of a stride-reduced thumbnail and per-channel mean, min and max of image-source rows.

    Channels come as b, g, r (or one grey channel repeated).
    """
    names = ["luma", *[f"{s}_{c}" for s in ("mean", "min", "max") for c in "bgr"]]

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def stats(img: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for h, w, c, data in zip(img["height"], img["width"], img["nChannels"], img["data"]):
            a = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)[:, :, :3].astype(np.float64)
            if a.shape[2] == 1:
                a = np.repeat(a, 3, axis=2)
            step = max(1, -(-max(h, w) // thumb))
            small = a[::step, ::step]
            # fixed values: luma weights of blue, green, red
            luma = (small * np.array([0.114, 0.587, 0.299])).sum(axis=2).mean()
            rows.append((luma, *a.mean(axis=(0, 1)), *a.min(axis=(0, 1)), *a.max(axis=(0, 1))))
        return pd.DataFrame(rows, columns=names)

    i = F.col(image)
    arg = F.struct(*[i[n].alias(n) for n in ("height", "width", "nChannels", "data")])
    return images.select(i["origin"].alias("origin"), stats(arg).alias("__s")).select("origin", "__s.*")


def mean_luma(pixels) -> Column:
    """Mean of a flat pixel array."""
    p = _c(pixels)
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(p)


def sector_mean(pairs: DataFrame, key: list[str], frame: str, base: str, h: int, w: int, n_sectors: int = 8
                ) -> DataFrame:
    """Brightest angular sector of frame - base around the centre: sector, centre angle, mean.

    Angle 0 is up, clockwise. A sector without pixels counts 0; ties go to the lower sector.
    """
    step = 360.0 / n_sectors
    z = F.arrays_zip(F.col(frame).alias("a"), F.col(base).alias("b"))
    px = pairs.select(*key, F.posexplode(z).alias("i", "p"))
    row, col = F.floor(F.col("i") / w), F.col("i") % w
    ang = F.pmod(F.degrees(F.atan2(col - w / 2, -(row - h / 2))), F.lit(360.0))
    d = F.col("p.a").cast("double") - F.col("p.b").cast("double")
    per = px.groupBy(*key, F.floor(ang / step).cast("int").alias("s")).agg(F.avg(d).alias("m"))
    seen = F.collect_set("s")
    absent = F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(n_sectors - 1)), seen))
    best = F.greatest(F.max(F.struct(F.col("m").alias("m"), (-F.col("s")).alias("n"))),
                      F.when(absent.isNotNull(), F.struct(F.lit(0.0).alias("m"), (-absent).alias("n"))))
    x = per.groupBy(*key).agg(best.alias("b"))
    sector = -F.col("b.n")
    return x.select(*key, sector.alias("sector"), ((sector + 0.5) * step).alias("center_deg"),
                    F.col("b.m").alias("mean_diff"))


def tile_change(pairs: DataFrame, key: list[str], before: str, after: str, h: int, w: int, *,
                band: tuple[float, float] = (0.0, 1.0), threshold: float = 8.0, grid: tuple[int, int] = (5, 9)
                ) -> DataFrame:
    """Tiles of the horizon band whose mean absolute change exceeds the threshold."""
    y0, y1 = int(h * band[0]), int(h * band[1])
    rows, cols = grid
    th, tw = (y1 - y0) / rows, w / cols

    def tile(pos, size, n):
        fits = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (
            F.floor(k * size) <= pos) & (pos < F.floor((k + 1) * size)))
        return F.get(fits, F.lit(0))
    z = F.arrays_zip(F.col(before).alias("a"), F.col(after).alias("b"))
    px = pairs.select(*key, F.posexplode(z).alias("i", "p"))
    px = px.withColumn("y", F.floor(F.col("i") / w)).where(F.col("y").between(y0, y1 - 1))
    px = px.select(*key, tile(F.col("y") - y0, th, rows).alias("tile_r"), tile(F.col("i") % w, tw, cols).alias("tile_c"),
                   F.abs(F.col("p.b").cast("double") - F.col("p.a").cast("double")).alias("d"))
    t = px.where("tile_r is not null and tile_c is not null").groupBy(*key, "tile_r", "tile_c").agg(
        F.avg("d").alias("m")).where(F.col("m") > threshold)
    return t.select(*key, "tile_r", "tile_c", F.round(F.least(F.col("m") / 255.0, F.lit(1.0)), 3).alias("confidence"),
                    F.round("m", 1).alias("mean_abs_diff"))
