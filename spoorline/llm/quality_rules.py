"""Operator 6, quality rules: rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, over_batches, row_key, saved, scratch, texts

SPACES, SYMBOLS, DIGITS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"0123456789"
#: Common words of the four languages, fixed values.
STOP_WORDS = frozenset(
    "the of and to in that is was for it with as on be at by this had not are but from or have an they which you were her all she there would their we him been has when who will more no if out so "
    "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis "
    "le la les de des du et un une est en que qui dans pour pas sur au par plus ne se ce il sont avec son aux elle ou mais comme nous leur cette ont "
    "el la los las de que y en un una ser se no por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde".encode().split()
)
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_kinds", "n_kinds", "n_digits", "longest")


def features(text: bytes) -> tuple[int, ...]:
    """FEATURES of one whole text, in that order. Words are maximal runs without ASCII space."""
    words = text.split()
    n = len(words)
    blanks = len(text) - len(text.translate(None, SPACES))
    chars = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    lines, dup, seen = 0, 0, set()
    for x in text.split(b"\n"):
        if x.strip():
            lines += 1
            if x in seen:
                dup += 1
            seen.add(x)
    repeat = 0
    if n > 3:
        three = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(three)) < len(three):
            first, again = set(), set()
            for x in three:
                (again if x in first else first).add(x)
            end = 0  # the first word that isn't counted yet
            for i, x in enumerate(three):
                if x in again:
                    repeat += i + 3 - max(i, end)
                    end = i + 3
    kinds = set(words)
    return n, chars - blanks, len(text) - len(text.translate(None, SYMBOLS)), dup, repeat, lines, len(kinds & STOP_WORDS), len(kinds), len(text) - len(text.translate(None, DIGITS)), max(map(len, words), default=0)


def rules() -> dict:
    """name -> (good, bad): conditions over FEATURES. A rule votes by the one that holds, or abstains."""
    c = {f: F.col(f).cast("double") for f in FEATURES}
    words, letters = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["word_chars"], F.lit(1.0))
    mean, symbols, dup, repeat = letters / words, c["n_symbols"] / words, c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0)), c["n_repeat_words"] / words
    return {
        "length": (c["n_words"] >= 80, c["n_words"] < 50),
        "word_length": ((mean >= 3) & (mean <= 9), (mean < 2.5) | (mean > 12)),
        "symbols": (symbols <= 0.05, symbols >= 0.2),
        "lines": ((dup == 0) & (c["n_lines"] >= 2), dup > 0.5),
        "repeats": (repeat <= 0.1, repeat > 0.3),
        "stop_words": (c["n_stop_kinds"] >= 3, (c["n_stop_kinds"] == 0) & (c["n_words"] >= 20)),
        "variety": (c["n_kinds"] >= 0.2 * words, (c["n_kinds"] < 0.1 * words) & (c["n_words"] < 2000)),
        "digits": (c["n_digits"] <= 0.05 * letters, c["n_digits"] > 0.25 * letters),
        "longest": (c["longest"] <= 60, c["longest"] > 400),
    }


#: Pseudo-counts of (bad, abstain, good) votes on good and on bad texts, for each rule, and of (bad, good) texts.
PRIOR_GOOD, PRIOR_BAD, PRIOR_CLASS = np.array([1.0, 15.0, 84.0]), np.array([30.0, 20.0, 50.0]), (10.0, 90.0)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and how often each occurs.

    The model: a text is good or bad, and each rule votes by its own probabilities given that. -> log prior odds of good,
    and weights[rule, vote + 1], the log ratio of that vote's probability on good and on bad texts (its accuracy).
    """
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    good = np.where((votes == -1).any(axis=1), 0.2, 0.95)
    odds, weights = 0.0, np.zeros((votes.shape[1], 3))
    for _ in range(rounds):
        g, b, old = counts * good, counts * (1 - good), weights
        odds = math.log((g.sum() + PRIOR_CLASS[1]) / (b.sum() + PRIOR_CLASS[0]))
        on_good = np.einsum("p,prv->rv", g, one_hot) + PRIOR_GOOD
        on_bad = np.einsum("p,prv->rv", b, one_hot) + PRIOR_BAD
        weights = np.log(on_good / on_good.sum(axis=1, keepdims=True)) - np.log(on_bad / on_bad.sum(axis=1, keepdims=True))
        score = odds + np.einsum("prv,rv->p", one_hot, weights)
        good = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        if np.abs(weights - old).max() < 1e-9:
            break
    return odds, weights


def judge(docs: DataFrame, threshold: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: rk, doc_id, FEATURES, base_failed, a vote of each rule (vote_*: 1, 0, -1), p_good, kept.

    base_failed: under 50 words, or over half of them in repeated 3-word windows. kept: not so, and p_good >= threshold.
    Null or empty text has no words and fails. Null ids and repeated rows each keep their row; an empty table gives none;
    other columns aren't read. Accuracies are estimated over all rows, from counts of vote patterns (at most 3^9).
    """

    def make():
        def step(b: pa.RecordBatch):
            found = [features(x) for x in texts(b)]
            yield pa.record_batch([b.column("rk"), b.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))], names=["rk", "doc_id", *FEATURES])

        return step

    seen = keyed(docs, text, doc_id).mapInArrow(over_batches(make), "rk binary, doc_id long, " + ", ".join(f"{f} long" for f in FEATURES))
    votes = [F.when(good, F.lit(1)).when(bad, F.lit(-1)).otherwise(F.lit(0)).alias(f"vote_{name}") for name, (good, bad) in rules().items()]
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    seen = saved(seen.select("*", base_failed.alias("base_failed"), *votes), "features")
    names = [f"vote_{name}" for name in rules()]
    patterns = seen.groupBy(*names).count().collect()
    odds, weights = estimate(np.array([[r[n] for n in names] for r in patterns], np.int64).reshape(-1, len(names)), np.array([r["count"] for r in patterns], float)) if patterns else (0.0, np.zeros((len(names), 3)))
    score = F.lit(float(odds))
    for n, w in zip(names, weights, strict=True):
        score = score + F.when(F.col(n) == 1, F.lit(float(w[2]))).when(F.col(n) == -1, F.lit(float(w[0]))).otherwise(F.lit(float(w[1])))
    p = 1 / (1 + F.exp(-score))
    return seen.withColumn("p_good", p).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that judge() keeps, with all columns."""
    with scratch(docs.sparkSession):
        gone = saved(judge(docs, threshold, text, doc_id).where(~F.col("kept")).select(F.col("rk").alias("__rk")).distinct(), "rejected", keep=True)
    return docs.join(gone, row_key(docs, text, doc_id) == gone["__rk"], "left_anti")
