"""Toxicity: a classifier whose scores do not move when an identity term is swapped, added or left out.

Counterfactual pairs are made of every sentence that names a group, and of one sentence of every labelled text with
a neutral mention of a group added: without it, and with another group. A pair counts by the features only one side
has, so texts never leave their tasks: features of whole texts are counted in Spark, and those the classes differ in come to the driver.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlens.llm.common import LOWER, NO_LETTER, chunks, mix, span_hashes, word_spans
from stormlens.session import cut

#: Words that name groups; in a labelled sentence each is swapped for others of its line.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
)
#: Neutral mentions in the languages of the corpus, with groups to put in.
MENTIONS = (
    ("The {} family next door says hello.", ("muslim", "jewish", "christian", "black", "white", "asian", "gay", "deaf", "immigrant")),
    ("La famille {} d'à côté dit bonjour.", ("musulmane", "juive", "chrétienne", "noire", "blanche", "asiatique", "homosexuelle", "sourde", "immigrée")),
    ("Die {} Familie von nebenan grüßt.", ("muslimische", "jüdische", "christliche", "schwarze", "weiße", "asiatische", "schwule", "gehörlose", "eingewanderte")),
    ("La familia {} de al lado saluda.", ("musulmana", "judía", "cristiana", "negra", "blanca", "asiática", "gay", "sorda", "inmigrante")),
)
#: Most labelled texts of a class that are learned from, whole.
PER_CLASS = 2500
#: Bytes of a word's start that are features of their own, beside the word.
PREFIXES = (4, 5, 6, 7, 8)
MIN_ROWS, MIN_Z = 4, 3.5
STEPS, RATE, DECAY, FAIRNESS = 400, 0.05, 3e-4, 5.0
_TABLE_BITS = 16


@dataclass
class Model:
    """Selected feature hashes (sorted), their weights, and the offset."""

    features: np.ndarray
    weights: np.ndarray
    offset: float


def word_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every lower-cased word and word start; hash 0 where a word is too short."""
    low = LOWER[buf]
    s, e, n = word_spans(low, off, NO_LETTER)
    found = [span_hashes(low, s, e)]
    for p in PREFIXES:
        h = mix(span_hashes(low, s, np.minimum(s + p, e)) + np.uint64(p))
        h[e - s < p] = 0
        found.append(h)
    return np.concatenate(found), np.tile(np.repeat(np.arange(len(n)), n), len(found))


def presence(text: str) -> np.ndarray:
    """Sorted distinct features of a text."""
    b = np.frombuffer(text.encode(errors="replace"), np.uint8)
    u = np.unique(word_features(b, np.array([0, len(b)]))[0])
    return u[u != 0]


def counterfactuals(text: str, terms=IDENTITY_TERMS, mentions=MENTIONS) -> list[tuple[str, str]]:
    """Pairs of a sentence and the same about another group, about nobody in particular, or with a neutral mention."""
    group = {t: line for line in terms for t in line}
    pattern = re.compile(r"\b(" + "|".join(sorted(group, key=len, reverse=True)) + r")\b", re.I)
    sentences = [x for x in re.split(r"(?<=[.!?])\s+|\n", text) if x]
    pairs = []
    for sentence in sentences:
        if not pattern.search(sentence):
            continue
        for step in (1, 2):
            def swap(m):
                line = group[m.group(0).lower()]
                return line[(line.index(m.group(0).lower()) + step) % len(line)]
            pairs.append((sentence, pattern.sub(swap, sentence)))
        pairs.append((sentence, pattern.sub("people", sentence)))
    if sentences:
        draw = zlib.crc32(text.encode(errors="replace"))
        sentence = sentences[draw % len(sentences)]
        frame, groups = mentions[draw // 7 % len(mentions)]
        one, other = groups[draw // 31 % len(groups)], groups[(draw // 31 + 1 + draw // 301 % (len(groups) - 1)) % len(groups)]
        pairs += [(sentence, f"{sentence} {frame.format(one)}"), (f"{sentence} {frame.format(one)}", f"{sentence} {frame.format(other)}")]
    return pairs


def pair_features(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Features that only one side of a pair has."""
    x, y = presence(a), presence(b)
    return np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each)."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(lists)), n)


def fit(k: int, rows: list[np.ndarray], labels: list[int], sides: list[tuple[np.ndarray, np.ndarray]], fairness: float = FAIRNESS) -> np.ndarray:
    """Weights of k features and the offset: logistic regression on presence, with `fairness` times the mean squared
    score change over pairs added to the loss. `rows` and `sides` hold numbers of features."""
    y = np.array(labels, float)
    (col, row), (ca, ra), (cb, rb) = _flat(rows), _flat([a for a, _ in sides]), _flat([b for _, b in sides])
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        score = np.bincount(row, w[col], minlength=len(y)) + w[-1]
        g = 1 / (1 + np.exp(-score)) - y
        grad = np.append(np.bincount(col, g[row], minlength=k) / len(y) + DECAY * w[:-1], g.mean())
        if sides and fairness:
            change = np.bincount(ra, w[ca], minlength=len(sides)) - np.bincount(rb, w[cb], minlength=len(sides))
            grad[:-1] += 2 * fairness / len(sides) * (np.bincount(ca, change[ra], minlength=k) - np.bincount(cb, change[rb], minlength=k))
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return w


class Scorer:
    """Looks the features of many texts up in the model."""

    def __init__(self, model: Model):
        self.model = model
        # first selected feature of each hash prefix; most prefixes have none
        self.edge = np.searchsorted(model.features, np.arange(1 << _TABLE_BITS, dtype=np.uint64) << np.uint64(64 - _TABLE_BITS))
        self.edge = np.append(self.edge, len(model.features))
        self.some = self.edge[1:] > self.edge[:-1]

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        h, text = word_features(buf, off)
        maybe = np.flatnonzero(self.some[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        h, text = h[maybe], text[maybe]
        k = len(self.model.features)
        at = np.searchsorted(self.model.features, h)
        ok = at < k
        ok[ok] = self.model.features[at[ok]] == h[ok]
        pair = np.unique(text[ok] * max(k, 1) + at[ok])
        z = np.bincount(pair // max(k, 1), self.model.weights[pair % max(k, 1)] if k else None, minlength=len(off) - 1)
        return 1 / (1 + np.exp(-np.clip(z + self.model.offset, -40, 40)))


def _score(model: Model):
    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            got = [scorer.score(buf, off) for _, _, buf, off in chunks(b, "__text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([*got, np.zeros(0)]))], names=["__row", "score"])
    return run


_GIVEN = "__id {}, __y int, __h long, __f array<bigint>, __a array<array<bigint>>, __b array<array<bigint>>"


def _given(terms, mentions):
    """Features of whole texts and of the sides of their pairs."""
    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("__t"))
            for lo in range(0, b.num_rows, 64):
                part = [t.as_py() for t in texts.slice(lo, 64)]
                sides = [[pair_features(*p) for p in counterfactuals(t, terms, mentions)] for t in part]
                lists = pa.list_(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(b.schema.get_field_index(c)).slice(lo, 64) for c in ("__id", "__y", "__h")),
                     pa.array([presence(t).view(np.int64) for t in part], pa.list_(pa.int64())),
                     pa.array([[x.view(np.int64) for x, _ in s] for s in sides], lists), pa.array([[y.view(np.int64) for _, y in s] for s in sides], lists)],
                    names=["__id", "__y", "__h", "__f", "__a", "__b"])
    return run


def _numbered(features: np.ndarray):
    """Arrays of features as numbers of the selected ones; others are left out."""
    def number(values) -> list[int]:
        x = np.array(values, np.int64).view(np.uint64)
        at = np.searchsorted(features, x)
        ok = at < len(features)
        ok[ok] = features[at[ok]] == x[ok]
        return at[ok].astype(np.int64)

    def run(batches):
        for b in batches:
            cols = {c: b.column(b.schema.get_field_index(c)) for c in ("__f", "__a", "__b")}
            pairs = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("__y")), pa.array([number(v.values.to_numpy(zero_copy_only=False)) for v in cols["__f"]], pa.list_(pa.int64())),
                 *(pa.array([[number(x) for x in v.as_py()] for v in cols[c]], pairs) for c in ("__a", "__b"))], names=["__y", "__f", "__a", "__b"])
    return run


def examples(docs: DataFrame, labels: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
             per_class: int = PER_CLASS, terms=IDENTITY_TERMS, mentions=MENTIONS) -> DataFrame:
    """Features of the whole texts of at most `per_class` ids of each class, those least by a hash of the id.

    An id labelled more than once counts in its higher class; of an id with several texts the one with the least hash is learned from.
    """
    rows = labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(
        F.max(F.col(label_col).cast("int")).alias("__y"))
    draw = F.xxhash64("__id", F.lit("toxicity"))
    # a bounded number of ids: sent to all tasks
    chosen = rows.where("__y = 1").orderBy(draw, "__id").limit(per_class).union(rows.where("__y = 0").orderBy(draw, "__id").limit(per_class))
    text = F.coalesce(F.col(text_col), F.lit(""))
    got = docs.select(F.col(id_col).alias("__id"), text.alias("__t")).join(F.broadcast(chosen), "__id").withColumn("__h", F.xxhash64("__t"))
    given = got.mapInArrow(_given(terms, mentions), _GIVEN.format(got.schema["__id"].dataType.simpleString()))
    return cut(given.groupBy("__id").agg(F.min_by(F.struct("__y", "__f", "__a", "__b"), "__h").alias("x")).select("x.*"))


def learn(docs: DataFrame, labels: DataFrame, rows: Column, fairness: float = FAIRNESS, **how) -> Model:
    """Model from the labelled rows where `rows` holds.

    Features are those in MIN_ROWS texts or more whose share differs between the classes by MIN_Z standard errors. Without both
    classes the score is their share everywhere.
    """
    given = examples(docs, labels, rows, **how)
    n = {r[0]: r[1] for r in given.groupBy("__y").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        p = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((p + 1e-3) / (1 - p + 1e-3))))
    count = given.select("__y", F.explode("__f").alias("f")).groupBy("f").agg(F.sum("__y").alias("ones"), F.count(F.lit(1)).alias("n"))
    p = F.col("n") / (n0 + n1)
    z = (F.col("ones") / n1 - (F.col("n") - F.col("ones")) / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    found = count.where((F.col("n") >= MIN_ROWS) & (F.abs(z) > MIN_Z)).select("f").collect()
    features = np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))
    numbers = "__y int, __f array<bigint>, __a array<array<bigint>>, __b array<array<bigint>>"
    got = sorted(given.mapInArrow(_numbered(features), numbers).collect())
    sides = [(np.array(a, np.int64), np.array(b, np.int64)) for r in got for a, b in zip(r[2], r[3])]
    w = fit(len(features), [np.array(r[1], np.int64) for r in got], [r[0] for r in got], [s for s in sides if len(s[0]) or len(s[1])], fairness)
    return Model(features, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Model, cols: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The named columns, score (0 to 1) and predicted (1 from 0.5 on) of every row.

    The whole text is scored; null and empty texts have no feature and get the offset's score.
    Repeated rows get equal scores.
    """
    rows = docs.select(F.struct(*[c.alias(k) for k, c in cols.items()]).alias("__row"), F.col(text_col).alias("__text"))
    kind = rows.schema["__row"].dataType.simpleString()
    got = rows.mapInArrow(_score(model), f"__row {kind}, score double")
    return got.select(*[F.col(f"__row.`{k}`").alias(k) for k in cols], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
