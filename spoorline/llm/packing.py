"""Operator 3, packing: deficit round-robin over source queues fills every window to the target token proportions.

The schedule is computed, not simulated. In each round a queue earns rate = weight x window tokens of credit; it is served
when it has at least a quantum, and what it doesn't use stays its deficit for later rounds. What a queue has sent after its
j-th service is therefore floor(j x max(rate, quantum)), in round ceil(that / rate), wherever its documents lie: each
document finds its services from its place in its queue alone, and deficits carry over windows and partitions alike.
Rounds are laid end to end and cut into sequences, so that only the very last sequence is not full.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from public_tokenizers import path
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, saved

#: The regular expression of the byte-level vocabularies, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rounds whose services one task numbers, and services that one task makes.
ROUNDS, SERVICES = 1024, 1 << 16


@cache
def encoder(ranks: str):
    """One a Python worker. The same identifiers as the .json file of the same vocabulary gives for plain text, at four times the speed."""
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@cache
def fallback(model: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(model)
    t.encode_special_tokens = True
    return t


#: The fast library's regular expression overflows its stack in very long runs of space.
_LONG_SPACE = re.compile(r"\s{10000}")


def token_ids(text: str, ranks: str, model: str) -> np.ndarray:
    if len(text) >= 10_000 and _LONG_SPACE.search(text):
        return np.array(fallback(model).encode(text, add_special_tokens=False).ids, np.uint32)
    return encoder(ranks).encode_to_numpy(text, disallowed_special=())


@cache
def added_tokens(model: str) -> dict[str, int]:
    """Content and id of the tokens that the .json file adds to its vocabulary."""
    with open(model, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@cache
def library(model: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(model)


def document_ids(text: str, ranks: str, model: str) -> np.ndarray:
    """The identifiers that the library gives by its default settings. token_ids() takes all of a text for plain text; texts
    that hold an added token, such as <|endoftext|>, go to the library whole."""
    if any(t in text for t in added_tokens(model)):
        return np.array(library(model).encode(text, add_special_tokens=False).ids, np.uint32)
    return token_ids(text, ranks, model)


def tokenized(docs: DataFrame, ranks: str, model: str, end_id: int, text: str, doc_id: str, source: str) -> DataFrame:
    """part, seq (place in its task), doc_id, queue, before (tokens of the queue earlier in the task), n, ids (as bytes)."""

    def run(batches):
        enc, part, seq, sent = encoder(ranks), TaskContext.get().partitionId(), 0, {}
        wide = np.dtype("<u2") if max(enc.max_token_value, end_id, *added_tokens(model).values()) < 1 << 16 else np.dtype("<u4")
        for b in batches:
            queues, rows = b.column("queue").to_pylist(), []
            for q, x in zip(queues, b.column("text").to_pylist(), strict=True):
                ids = np.append(document_ids(x, ranks, model), end_id).astype(wide) if x else np.array([end_id], wide)
                rows.append((part, seq, sent.get(q, 0), len(ids), ids.tobytes()))
                sent[q] = sent.get(q, 0) + len(ids)
                seq += 1
            if rows:
                part_, seq_, before, n, ids = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(part_, pa.int32()), pa.array(seq_, pa.int64()), b.column("doc_id"), b.column("queue"), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["part", "seq", "doc_id", "queue", "before", "n", "ids"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("queue"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(released(run), "part int, seq long, doc_id long, queue string, before long, n long, ids binary")


def services(totals: DataFrame, targets: dict[str, float] | None, alpha: float, window: int, quantum: int) -> tuple[DataFrame, DataFrame]:
    """totals: queue, total -> (queues: queue, total, rate, step; services: queue, j, lo, hi, g0 (place among all tokens))."""
    spark = totals.sparkSession
    if targets:
        given = spark.createDataFrame([(str(q), float(w)) for q, w in targets.items()], "queue string, weight double")
        weighed = totals.join(F.broadcast(given), "queue", "left").fillna(float(min(targets.values())), ["weight"])  # as many rows as the caller names
    else:
        weighed = totals.withColumn("weight", F.col("total").cast("double") ** alpha)
    whole = weighed.agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("whole"))
    rate = F.when(F.col("weight") > 0, F.col("weight") / F.col("whole") * window).otherwise(F.lit(float(window)))
    queues = weighed.crossJoin(F.broadcast(whole)).select("queue", "total", "weight", rate.alias("rate"))  # one row
    queues = queues.withColumn("step", F.greatest("rate", F.lit(float(quantum)))).withColumn("n", F.ceil(F.col("total") / F.floor("step")) + 1)
    queues = saved(queues, "queues")
    size = queues.agg(F.sum(F.floor(F.col("n") / SERVICES) + 1).alias("blocks"), F.max(F.when(F.col("weight") > 0, F.ceil(F.col("n") * F.col("step") / F.col("rate")))).alias("rounds")).first()
    after = F.when(F.col("weight") > 0, F.lit(0)).otherwise(F.lit((size["rounds"] or 0) + 1))  # queues of no weight come when the others are done
    j = F.col("j")
    at = lambda k: F.least(F.floor(k * F.col("step")).cast("long"), F.col("total"))
    # a row for each service, made by many tasks: first a row for each SERVICES of them
    blocks = queues.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / SERVICES)))).repartition(max(1, min(int(size["blocks"] or 1), 4096)), "queue", "b")
    each = blocks.withColumn("j", F.explode(F.sequence(F.col("b") * SERVICES + 1, F.least((F.col("b") + 1) * SERVICES, F.col("n") + 1))))
    each = each.select("queue", "j", at(j - 1).alias("lo"), at(j).alias("hi"), (F.ceil(j * F.col("step") / F.col("rate") - 1e-6) + after).alias("round")).where("hi > lo")
    each = saved(each.withColumn("block", F.floor(F.col("round") / ROUNDS)), "services")
    blocks = each.groupBy("block").agg(F.sum(F.col("hi") - F.col("lo")).alias("size"))
    blocks = blocks.select("block", F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy("block").orderBy("round", "queue", "j").rowsBetween(Window.unboundedPreceding, -1))
    numbered = each.withColumn("before", F.coalesce(before, F.lit(0))).join(blocks, "block")
    # stored, so that its size is known: it grows with the input, and must not be taken for small and broadcast
    return queues, saved(numbered.select("queue", "j", "lo", "hi", (F.col("base") + F.col("before")).alias("g0")), "numbered")


def pack(
    docs: DataFrame,
    targets: dict[str, float] | None = None,
    alpha: float = 1.0,
    length: int = 1024,
    window: int = 64 * 1024,
    quantum: int = 1024,
    end_id: int = 0,
    ranks: str = path("byte_bpe_50k.tiktoken"),
    model: str = path("byte_bpe_50k.json"),
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    with_ids: bool = False,
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, and with with_ids the ids.

    targets: weight of each source. A source that they don't name gets the least weight named, one of weight 0 comes when the
    others are done. Without targets a source weighs its tokens to the power of alpha: at 1 all queues end together, below 1
    small sources come before their share. A queue that runs dry leaves its share to the others, and no token is dropped.
    A window is one round; its sequences hold `length` ids. Null or empty text is the end id alone. A null source is the
    queue "". Null ids and repeated rows each keep their row; an empty table gives none; other columns aren't read.
    """
    tok = saved(tokenized(docs, ranks, model, end_id, text, doc_id, source), "tokens")
    by_part = tok.groupBy("queue", "part").agg(F.sum("n").alias("sent"))
    by_part = saved(by_part.withColumn("base", F.coalesce(F.sum("sent").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "parts")
    queues, served = services(by_part.groupBy("queue").agg(F.sum("sent").alias("total")), targets, alpha, window, quantum)
    # both tables are small and stored, so Spark broadcasts them by their size, or else shuffles
    placed = tok.select("part", "seq", "queue", "before", "n").join(by_part.select("queue", "part", "base"), ["queue", "part"]).join(queues.select("queue", "step"), "queue")
    x = F.col("base") + F.col("before")

    def service(x):
        j = F.floor(x / F.col("step"))
        j = F.when(F.floor((j + 1) * F.col("step")) <= x, j + 1).when(F.floor(j * F.col("step")) > x, j - 1).otherwise(j)
        return (j + 1).cast("long")

    pieces = placed.select("part", "seq", "queue", x.alias("x"), "n", F.explode(F.sequence(service(x), service(x + F.col("n") - 1))).alias("j")).join(served, ["queue", "j"])
    first, last = F.greatest("x", "lo"), F.least(F.col("x") + F.col("n"), F.col("hi"))
    pieces = pieces.where(last > first).select("part", "seq", (first - F.col("x")).alias("start"), (last - first).alias("len"), (F.col("g0") + first - F.col("lo")).alias("g"))
    cut = F.expr(f"transform(sequence(g div {length}, (g + len - 1) div {length}), s -> struct(start + greatest(s * {length} - g, 0) AS start, least(g + len, (s + 1) * {length}) - greatest(g, s * {length}) AS len, s AS sequence_id, greatest(g - s * {length}, 0) AS offset))")
    pieces = pieces.groupBy("part", "seq").agg(F.flatten(F.collect_list(cut)).alias("pieces"))

    def run(batches):
        for b in batches:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "ids"]
            rows = []
            for d, q, n, raw, ps in zip(*(b.column(c).to_pylist() for c in ("doc_id", "queue", "n", "ids", "pieces")), strict=True):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                for p in sorted(ps, key=lambda p: p["start"]):
                    own = ids[p["start"] : p["start"] + p["len"]]
                    rows.append((d, p["start"], p["len"], zlib.crc32(own.tobytes()), n, p["sequence_id"], p["offset"], q, own.tolist() if with_ids else None))
            if rows:
                kinds = [*[pa.int64()] * 7, pa.string(), pa.list_(pa.int64())]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    joined = tok.join(pieces, ["part", "seq"]).select("doc_id", "queue", "n", "ids", "pieces")
    out = joined.mapInArrow(released(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string, ids array<long>")
    return out if with_ids else out.drop("ids")


def sequences(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (length of them), n_ids (before padding), of pack(..., with_ids=True)."""
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    out = pieces.groupBy("sequence_id").agg(ids.alias("ids"))
    return out.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), F.lit(length) - F.size("ids"))).alias("ids"), F.size("ids").cast("long").alias("n_ids"))
