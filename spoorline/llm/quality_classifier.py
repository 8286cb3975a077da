"""Operator 7, quality classifier: co-training of a text view and a metadata view that teach each other.

Both views of every document are stored once. In each round all documents are scored by either view, and those that it is surest
of become labelled examples of the other; a bounded sample of labelled rows starts them off.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast, over_batches, released, saved
from .quality_rules import features

TEXT_BINS, META_BINS = 192, 96


def text_view(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of the whole text by share, and what its words and lines look like."""
    x = np.frombuffer(text, np.uint8).astype(np.uint32)
    out = np.zeros(TEXT_BINS + 9)
    if len(x) >= 3:
        h = (x[:-2] * np.uint32(40503) ^ x[1:-1] * np.uint32(60493) ^ x[2:] * np.uint32(30011)) % np.uint32(TEXT_BINS)
        out[:TEXT_BINS] = np.sqrt(np.bincount(h, minlength=TEXT_BINS) / len(h))
    n, chars, symbols, dup, repeat, lines, stops, kinds, digits, longest = features(text)
    w, c = max(n, 1), max(chars, 1)
    out[TEXT_BINS:] = np.log1p(n), c / w / 10, min(symbols / w, 3), dup / max(lines, 1), repeat / w, stops / 10, kinds / w, digits / c, np.log1p(longest) / 5
    return out


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Source, language and length class, each alone and the first two together, in hashed bins."""
    out = np.zeros(META_BINS + 1)
    size = -1 if n_chars is None else int(np.log2(max(int(n_chars), 1)))
    for x in (f"s{source}", f"l{lang}", f"n{size}", f"sl{source}|{lang}"):
        out[xxhash.xxh3_64_intdigest(x) % META_BINS] = 1
    out[META_BINS] = max(size, 0) / 16
    return out


class Logistic:
    """Ridge logistic regression by Newton steps, on standardised features; then Platt calibration on other rows."""

    def __init__(self, ridge: float = 3.0):
        self.ridge, self.scale, self.shift = ridge, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.std])
        self.w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], self.ridge)
        ridge[0] = 1e-3
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.w[0] + ((x - self.mean) / self.std) @ self.w[1:]

    def calibrate(self, x: np.ndarray, y: np.ndarray):
        s = self.score(x)
        c = Logistic(0.1).fit(s[:, None], (y * len(y) + 0.5) / (len(y) + 1))
        self.scale, self.shift = c.w[1] / c.std[0], c.w[0] - c.w[1] * c.mean[0] / c.std[0]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.scale * self.score(x) + self.shift


class CoTrained:
    """Two calibrated views and how their log odds are weighed."""

    def __init__(self, text: Logistic, meta: Logistic, both: Logistic):
        self.text, self.meta, self.both = text, meta, both

    def log_odds(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.log_odds(t), self.meta.log_odds(m)
        return a, b, self.both.score(np.column_stack([a, b]))


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def surest(features: DataFrame, teachers: dict[str, Logistic], learned: dict[str, set[int]], most: int, sure: float) -> list[tuple]:
    """What two views teach each other: (learner, y, p, key, x), for each learner ("t" or "m") and label at most `most` rows of
    features, those that the other view is surest of. All rows are scored; tasks pass on their own surest only, in two levels."""
    spark = features.sparkSession
    shared = broadcast(spark, (teachers, {k: np.array(sorted(v), np.int64) for k, v in learned.items()}))
    names = ["learner", "y", "p", "key", "x"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float32()))
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def best(rows: list[tuple]) -> list[tuple]:
        out = []
        for learner in ("t", "m"):
            for y in (0, 1):
                out += sorted((r for r in rows if r[:2] == (learner, y)), key=lambda r: (-r[2] if r[1] else r[2], r[3]))[:most]
        return out

    def score(batches):
        model, known = shared.value
        kept: list[tuple] = []
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False)
            views = {v: _matrix(b, v) for v in ("t", "m")}
            for learner, teacher in (("t", "m"), ("m", "t")):
                p = _probability(model[teacher].score(views[teacher]))
                fresh = ~np.isin(key, known[learner])
                for y, ok, rank in ((0, fresh & (p <= 1 - sure), p), (1, fresh & (p >= sure), -p)):
                    some = np.flatnonzero(ok)
                    some = some[np.lexsort((key[some], rank[some]))][:most]
                    kept += [(learner, y, float(p[i]), int(key[i]), views[learner][i].astype(np.float32)) for i in some]
            if len(kept) > 16 * most:
                kept = best(kept)
        if kept:
            yield batch(best(kept))

    def again(batches):
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names), strict=True)]
        if rows:
            yield batch(best(rows))

    schema = "learner string, y int, p double, key long, x array<float>"
    first = features.select("key", "t", "m").mapInArrow(released(score), schema)
    level = max(1, math.isqrt(features.rdd.getNumPartitions()))
    found = first.repartition(level).mapInArrow(released(again), schema).collect()  # at most 4 x most rows from each of the second level's tasks
    return best([(r["learner"], r["y"], r["p"], r["key"], r["x"]) for r in found])


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)


def folds(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n labelled rows: those that train, every eighth that calibrates the views, and every eighth that weighs them."""
    place = np.arange(n) % 8
    return np.isin(place, (3, 7), invert=True), place == 3, place == 7


def co_train(t: np.ndarray, m: np.ndarray, y: np.ndarray, teach: Callable[[dict[str, Logistic], dict[str, set[int]]], list[tuple]], rounds: int = 4) -> CoTrained:
    """Views t and m of labelled rows. In each round teach(views so far, keys learned so far) gives the rows that either view
    labels for the other to learn from."""
    base, calibrates, weighs = folds(len(y))
    own = {"t": t, "m": m}
    added: dict[str, list[tuple]] = {"t": [], "m": []}

    def fit(view: str) -> Logistic:
        more = added[view]
        x = np.concatenate([own[view][base], np.array([r[4] for r in more], float).reshape(len(more), -1)]) if more else own[view][base]
        return Logistic().fit(x, np.concatenate([y[base], np.array([r[1] for r in more], float)]))

    for _ in range(rounds):
        for r in teach({v: fit(v) for v in own}, {v: {r[3] for r in added[v]} for v in own}):
            added[r[0]].append(r)
    text, meta = (fit(v).calibrate(own[v][calibrates], y[calibrates]) for v in own)
    both = Logistic(1.0).fit(np.column_stack([text.log_odds(t[weighs]), meta.log_odds(m[weighs])]), y[weighs])
    return CoTrained(text, meta, both)


def _views(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    t = np.stack([text_view((x or "").encode()) for x in b.column("text").to_pylist()])
    m = np.stack([meta_view(*r) for r in zip(*(b.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)])
    return t.astype(np.float32), m.astype(np.float32)


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, key, t, m): both views of every document, of whole texts; key is a hash of id and text."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))

    def make():
        def step(b: pa.RecordBatch):
            views = [pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel())) for v in _views(b)]
            yield pa.record_batch([b.column("doc_id"), b.column("key"), *views], names=["doc_id", "key", "t", "m"])

        return step

    keyed = narrow.withColumn("key", F.xxhash64("doc_id", "text"))
    return saved(keyed.mapInArrow(over_batches(make), "doc_id long, key long, t array<float>, m array<float>"), "features")


def train(features: DataFrame, labels: DataFrame, rows: int = 4000, rounds: int = 4, most: int = 200, sure: float = 0.95) -> CoTrained:
    """Fitted on at most `rows` labelled documents, the first by a hash of their id. All others, however many, are what the
    views label for each other: in each round `most` of each label at most, with probability `sure`. Labels that are null,
    other than 0 or 1, or contradict each other are left out, and of the rows of a repeated id the first by key is taken."""
    good = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"), F.max("quality").cast("int").alias("y2")).where("y = y2").select("doc_id", "y")
    order = F.xxhash64("doc_id", F.lit(17))
    some = features.groupBy("doc_id").agg(F.min("key").alias("key")).join(good, "doc_id").orderBy(order, "doc_id").limit(rows)
    some = saved(some.select("doc_id", "key", "y"), "sample")
    found = features.join(F.broadcast(some.select("key", "y")), "key").dropDuplicates(["key"]).select("key", "y", "t", "m").collect()  # `rows` rows at most
    found.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r["key"])), r["key"]))
    y = np.array([r["y"] for r in found], float)
    if any(len(set(y[f])) < 2 for f in folds(len(y))):  # nothing to learn from: no evidence either way
        return CoTrained(_constant(TEXT_BINS + 9), _constant(META_BINS + 1), _constant(2))
    t, m = (np.array([r[v] for r in found], float) for v in ("t", "m"))
    pool = features.join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti")
    return co_train(t, m, y, lambda views, learned: surest(pool, views, learned, most, sure), rounds)


def _constant(k: int) -> Logistic:
    out = Logistic()
    out.mean, out.std, out.w = np.zeros(k), np.ones(k), np.zeros(k + 1)
    return out


def score(features: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """Per row of features: doc_id, p_text, p_meta, p_quality, kept (p_quality >= threshold), by whole texts.

    Null or empty text has the features of no words; null source, language and length are values of their own. Without two
    classes of labels to learn from, every probability is one half and every row is kept. A probability equal to the threshold
    keeps its row. Null ids and repeated rows each keep their row; an empty table gives none; other columns aren't read.
    """
    shared = broadcast(features.sparkSession, model)  # some thousand numbers

    def make():
        known = shared.value

        def step(b: pa.RecordBatch):
            a, m, both = known.log_odds(_matrix(b, "t"), _matrix(b, "m"))
            p = [1 / (1 + np.exp(-np.clip(v, -500, 500))) for v in (a, m, both)]
            yield pa.record_batch([b.column("doc_id"), *map(pa.array, p), pa.array(p[2] >= threshold)], names=["doc_id", "p_text", "p_meta", "p_quality", "kept"])

        return step

    return features.select("doc_id", "t", "m").mapInArrow(over_batches(make), "doc_id long, p_text double, p_meta double, p_quality double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """score() of docs by what train() learns from labels and from all of docs."""
    features = featured(docs)
    return score(features, train(features, labels, **options))
