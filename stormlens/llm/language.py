"""Language identification: a byte convolutional network trained in numpy on labelled text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlens.llm.common import chunks

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: Bound of the labelled sample: excerpts of at most EXCERPT characters, so many per language.
PER_LANGUAGE, EXCERPT = 600, 400
EPOCHS, BATCH, RATE, DECAY = 5, 48, 0.02, 1e-4
UNDETERMINED = "und"
_HALO = max(WIDTHS) - 1


@dataclass
class ByteConv:
    """Per width w: w tables (256, FILTERS), what each byte at each place of a filter adds; a softmax layer on the maxima."""

    labels: list[str]
    taps: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def maxima(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pooled responses, their places) of byte windows (n, WINDOW + halo); the slow form used to learn."""
        best, place = [], []
        for t in self.taps:
            y = t[0][x[:, :WINDOW]]
            for k in range(1, len(t)):
                y = y + t[k][x[:, k:WINDOW + k]]
            p = y.argmax(1)
            place.append(p)
            best.append(np.take_along_axis(y, p[:, None], 1)[:, 0])
        return np.concatenate(best, 1), np.concatenate(place, 1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.dense + self.offset


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(text: bytes | np.ndarray) -> np.ndarray:
    """Windows of fixed length over all bytes; the last is padded with zeros, each sees the start of the next."""
    b = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    n = max(1, -(-len(b) // WINDOW))
    padded = np.zeros(n * WINDOW + _HALO, np.uint8)
    padded[:len(b)] = b
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + _HALO)[::WINDOW]


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> ByteConv:
    """Adam on the cross-entropy of windows, among them short crops so that short texts are known too."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    f = len(WIDTHS) * FILTERS
    net = ByteConv(names, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
                   np.zeros(f, np.float32), rng.normal(0, 0.3, (f, max(1, len(names)))).astype(np.float32),
                   np.zeros(max(1, len(names)), np.float32))
    if len(names) < 2:
        return net
    y = np.array([names.index(c) for c in labels])
    params = [*net.taps, net.bias, net.dense, net.offset]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            x = np.zeros((len(pick), WINDOW + _HALO), np.uint8)
            for r, i in enumerate(pick):
                t = texts[i]
                size = WINDOW + _HALO if rng.random() < 0.5 else int(rng.integers(6, 120))
                s = int(rng.integers(0, max(1, len(t) - size + 1)))
                t = t[s:s + size]
                x[r, :len(t)] = np.frombuffer(t, np.uint8)
            pooled, place = net.maxima(x)
            hidden = np.maximum(pooled + net.bias, 0)
            p = softmax(hidden @ net.dense + net.offset)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            back = (p @ net.dense.T) * (hidden > 0)
            grads = []
            for j, w in enumerate(WIDTHS):
                g = np.zeros_like(net.taps[j])
                b = back[:, j * FILTERS:(j + 1) * FILTERS]
                pl = place[:, j * FILTERS:(j + 1) * FILTERS]
                for k in range(w):
                    np.add.at(g[k], (np.take_along_axis(x, pl + k, 1), np.arange(FILTERS)[None]), b)
                grads.append(g)
            grads += [back.sum(0), hidden.T @ p + DECAY * net.dense, p.sum(0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                params[i] -= (RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


class Folded:
    """The same network for many windows: the first two and last two taps of a filter become one table over byte pairs."""

    def __init__(self, net: ByteConv):
        self.net = net
        a, b, c = net.taps
        pair = lambda x, y: (x[:, None] + y[None]).reshape(65536, FILTERS)
        self.two, self.three, self.four = pair(a[0], a[1]), pair(b[0], b[1]), pair(c[0], c[1])
        self.third, self.last = b[2], pair(c[2], c[3])

    def pooled(self, x: np.ndarray) -> np.ndarray:
        code = x[:, :-1].astype(np.intp) << 8
        code |= x[:, 1:]
        head, tail = code[:, :WINDOW], code[:, 2:WINDOW + 2]
        out = []
        for y in (self.two.take(head, 0), self.three.take(head, 0), self.four.take(head, 0)):
            if len(out) == 1:
                y += self.third.take(x[:, 2:WINDOW + 2], 0)
            elif len(out) == 2:
                y += self.last.take(tail, 0)
            n = WINDOW
            while n > 1:
                n //= 2
                y = np.maximum(y[:, :n], y[:, n:])
            out.append(y[:, 0])
        return np.concatenate(out, 1)

    def probabilities(self, x: np.ndarray, at_once: int = 64) -> np.ndarray:
        return np.concatenate([softmax(self.net.logits(self.pooled(x[i:i + at_once]))) for i in range(0, len(x), at_once)])



def _identify(net: ByteConv, field: str | None):
    """Batches of (__row, __letters[, __text]); with `field`, the text is that field of the row."""
    def run(batches):
        model = Folded(net) if net.labels else None
        for batch in batches:
            if field is not None:
                batch = batch.append_column("__text", batch.column(0).field(field))
            letters = batch.column(1).to_numpy(zero_copy_only=False)
            best = np.full(batch.num_rows, -1)
            score = np.zeros(batch.num_rows)
            for lo, hi, buf, off in chunks(batch, "__text", 1 << 18):
                rows = np.flatnonzero(letters[lo:hi])
                if model is None or not len(rows):
                    continue
                sizes = off[rows + 1] - off[rows]
                count = -(-sizes // WINDOW)
                # all windows of the chunk; a long text is taken in parts
                x = np.concatenate([windows_of(buf[off[r]:off[r + 1]]) for r in rows])
                p = model.probabilities(x).astype(np.float64)
                first = np.concatenate([[0], np.cumsum(count)[:-1]])
                weight = np.full(len(x), float(WINDOW))
                weight[first + count - 1] = sizes - (count - 1) * WINDOW
                mean = np.add.reduceat(p * weight[:, None], first, axis=0) / sizes[:, None]
                best[lo + rows] = mean.argmax(1)
                score[lo + rows] = np.clip(mean.max(1), 0, 1)
            names = np.array([*net.labels, UNDETERMINED], dtype=object)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score)], names=["__row", "lang_pred", "score"])
    return run


def sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str, learn: Column, per_language: int = PER_LANGUAGE) -> list[tuple[bytes, str]]:
    """At most `per_language` labelled excerpts of each language, chosen by a hash of the id."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    draw = F.xxhash64(F.col(id_col), F.lit("language")).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))
    n = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().collect()}
    if not n:
        return []
    share = F.create_map(*[x for k, c in sorted(n.items()) for x in (F.lit(k), F.lit(min(1.0, per_language / c)))])
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit("place")), F.greatest(F.length(text_col) - EXCERPT, F.lit(1))).cast("int") + 1
    got = rows.where(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("l"), draw.alias("d"), F.substring(F.col(text_col), at, F.lit(EXCERPT)).alias("t"))
    kept: dict[str, int] = {}
    out = []
    for r in sorted(got.limit(2 * per_language * len(n)).collect(), key=lambda r: (r.l, r.d, r.t)):
        kept[r.l] = kept.get(r.l, 0) + 1
        if kept[r.l] <= per_language:
            out.append((r.t.encode(), r.l))
    return out


def learn(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          per_language: int = PER_LANGUAGE) -> ByteConv:
    """Network from the rows where `learn` holds; without any labelled row it knows no language."""
    got = sample(docs, text_col, lang_col, id_col, learn, per_language)
    return train([t for t, _ in got], [c for _, c in got])


def identify(docs: DataFrame, net: ByteConv, text_col: str = "text") -> DataFrame:
    """All columns of `docs` as the struct __row, lang_pred and score.

    The score is the mean probability over all windows, weighted by their bytes. Null texts and
    texts without a letter are `und` with score 0, as is everything if no language was learned.
    Ties go to the language that sorts first. Rows and their number stay.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _apply(docs.select(row.alias("__row"), _letters(text_col).alias("__letters")), net, text_col)


def identify_ids(docs: DataFrame, net: ByteConv, cols: dict[str, Column], text_col: str = "text") -> DataFrame:
    """Only the named columns, lang_pred and score; see `identify`."""
    row = F.struct(*[c.alias(k) for k, c in cols.items()])
    got = _apply(docs.select(row.alias("__row"), _letters(text_col).alias("__letters"), F.col(text_col).alias("__text")), net, None)
    return got.select(*[F.col(f"__row.`{k}`").alias(k) for k in cols], "lang_pred", "score")


def _letters(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def _apply(rows: DataFrame, net: ByteConv, field: str | None) -> DataFrame:
    kind = rows.schema["__row"].dataType.simpleString()
    return rows.mapInArrow(_identify(net, field), f"__row {kind}, lang_pred string, score double")
