"""Operator 4, line dedup: Bloom filters of once-seen and twice-seen lines; only suspected repeats are shuffled."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom, suspected
from .common import broadcast, keyed, over_batches, row_key, saved, scratch, texts


def line_keys(text: bytes, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text, and each one's key: ASCII space stripped, A-Z lower-cased; None if under `least` code points."""
    lines = text.split(b"\n")
    keys: list[bytes | None] = []
    for x in lines:
        k = x.strip().lower()
        keys.append(k if len(k) >= least and (len(k) >= 4 * least or len(k.decode("utf-8", "replace")) >= least) else None)
    return lines, keys


def _hashed(keys: set[bytes] | list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def twice_seen(docs: DataFrame, least: int) -> np.ndarray:
    """The filter of keys that two or more rows hold."""
    return bloom(docs.select("text"), lambda b: [_hashed(ks) for x in texts(b) if (ks := {k for k in line_keys(x, least)[1] if k is not None})], "twice")


def line_drops(docs: DataFrame, least: int = 20, in_docs: int = 3, keep_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """docs as keyed() gives them -> (scanned, drops).

    scanned: rk, doc_id, n_lines, kept_sha256 (null where a line is suspected), text (null where none is, unless keep_text).
    drops: rk, keys (128-bit hashes of the keys whose lines go).
    """
    spark = docs.sparkSession
    bits = broadcast(spark, twice_seen(docs, least))

    def make():
        known = bits.value

        def step(b: pa.RecordBatch):
            n_lines, sha, text, sus = [], [], [], []
            for x in texts(b):
                lines, keys = line_keys(x, least)
                ks = list({k for k in keys if k is not None})
                hit = suspected(known, _hashed(ks)) if ks else ()
                found = [xxhash.xxh3_128_digest(k) for k, y in zip(ks, hit, strict=True) if y]
                n_lines.append(len(lines))
                sus.append(found)
                sha.append(None if found else hashlib.sha256(x).hexdigest())
                text.append(x if found or keep_text else None)
            yield pa.record_batch([b.column("rk"), b.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary()), pa.array(sus, pa.list_(pa.binary()))], names=["rk", "doc_id", "n_lines", "kept_sha256", "text", "sus"])

        return step

    scanned = saved(docs.mapInArrow(over_batches(make), "rk binary, doc_id long, n_lines long, kept_sha256 string, text binary, sus array<binary>"), "scanned")
    found = scanned.select("rk", F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.explode("sus").alias("key"))
    # exact: 128-bit hashes; the pairs are made distinct first, so that a hot line is counted map-side
    repeated = saved(found.groupBy("key", "d").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n"), F.max("d").alias("last")).where(F.col("n") >= in_docs).select("key", "last"), "repeated")
    drops = found.join(repeated, "key").where(F.col("d") < F.col("last")).groupBy("rk").agg(F.collect_set("key").alias("keys"))
    return scanned, drops


def _kept(text: bytes, gone: set[bytes], least: int) -> tuple[bytes, int]:
    lines, keys = line_keys(text, least)
    left = [x for x, k in zip(lines, keys, strict=True) if k is None or xxhash.xxh3_128_digest(k) not in gone]
    return b"\n".join(left), len(lines) - len(left)


def dedup_lines(docs: DataFrame, least: int = 20, in_docs: int = 3, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped, kept_sha256, and with with_text also rk and the kept text.

    A key of at least `least` code points in at least `in_docs` documents (distinct ids; all null ids count as one, the
    smallest) loses its lines everywhere but in the largest id that holds it, where all its lines stay. Null or empty
    text is one empty line. Repeated rows are one document. An empty table gives no row. Other columns aren't read.
    """
    scanned, drops = line_drops(keyed(docs, text, doc_id), least, in_docs, with_text)

    def make():
        def step(b: pa.RecordBatch):
            cols = {n: b.column(n).to_pylist() for n in ("kept_sha256", "text", "keys")}
            sha, n, out = [], [], []
            for s, x, gone in zip(cols["kept_sha256"], cols["text"], cols["keys"], strict=True):
                left, k = _kept(x, set(gone), least) if gone else (x, 0)
                sha.append(hashlib.sha256(left).hexdigest() if s is None else s)
                n.append(k)
                out.append(left if with_text else None)
            names = ["rk", "doc_id", "n_lines", "n_dropped", "kept_sha256", "text"]
            yield pa.record_batch([b.column("rk"), b.column("doc_id"), b.column("n_lines"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(out, pa.binary()).cast(pa.string())], names=names)

        return step

    joined = scanned.join(drops, "rk", "left").select("rk", "doc_id", "n_lines", "kept_sha256", "text", "keys")
    out = joined.mapInArrow(over_batches(make), "rk binary, doc_id long, n_lines long, n_dropped long, kept_sha256 string, text string")
    return out if with_text else out.drop("rk", "text")


def without_repeats(docs: DataFrame, least: int = 20, in_docs: int = 3, text: str = "text", doc_id: str = "doc_id", chars: str | None = "n_chars") -> DataFrame:
    """docs with the lines that dedup_lines() drops cut from their texts, and the count of characters, if any, made anew.

    All columns and rows stay, texts that lose all their lines as empty ones.
    """
    with scratch(docs.sparkSession):
        _, drops = line_drops(keyed(docs, text, doc_id), least, in_docs)
        drops = saved(drops.select(F.col("rk").alias("__rk"), F.col("keys").alias("__keys")), "drops", keep=True)
    at, names = docs.columns.index(text), docs.columns

    def make():
        def step(b: pa.RecordBatch):
            out = [x if x is None or not gone else _kept(x, set(gone), least)[0] for x, gone in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(len(names)).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(out, pa.binary()).cast(pa.string()) if i == at else b.column(i) for i in range(len(names))], names=names)

        return step

    joined = docs.join(drops, row_key(docs, text, doc_id) == drops["__rk"], "left").select(*[docs[c] for c in names], drops["__keys"])
    out = joined.mapInArrow(over_batches(make), docs.schema)
    return out.withColumn(chars, F.coalesce(F.length(text).cast(docs.schema[chars].dataType), F.col(chars))) if chars in names else out
