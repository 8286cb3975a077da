"""Operator 10, benchmark decontamination, in DataFrame functions only: a hash set of test n-grams against all windows.

Documents are scanned once: each window of words is hashed and looked up in the broadcast set of the test n-grams' hashes, and
only windows that it holds leave the row, with their words. They are verified by word against the n-grams themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, row_key, saved, scratch

_UPPER = "".join(map(chr, range(65, 91)))
_SEPARATORS = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
#: A word and what separates it from the next.
_PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: N-grams whose hashes are broadcast (8 bytes each). The set of a larger benchmark is joined as Spark sees fit, by shuffling.
BROADCAST = 4_000_000


def words(text: Column) -> Column:
    """A-Z lower-cased; the maximal runs of what is no ASCII but a digit or letter. Null: null."""
    return F.array_remove(F.split(F.translate(text, _UPPER + _SEPARATORS, _UPPER.lower() + " " * len(_SEPARATORS)), " "), "")


def benchmark_windows(benchmark: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(win, len, h, items): each distinct window of n words, or of an item's fewer, its hash, and its items as strings."""
    w = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    wins = w.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.slice("w", i, n))).alias("win"))
    return wins.groupBy("win").agg(F.collect_set("item").alias("items")).select("win", F.size("win").alias("len"), F.xxhash64(_word_hashes("win")).alias("h"), "items")


def _word_hashes(w: str) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """docs as keyed() gives them -> (scanned: rk, doc_id, n_words), (found: rk, start (from 1), len, items), windows that occur."""
    wins = saved(benchmark_windows(benchmark, n, item_id=item_id), "windows")
    lens = [r[0] for r in wins.select("len").distinct().collect()]  # n numbers at most
    grams = wins.select(F.col("h").alias("gram"), F.col("len").alias("gram_len")).distinct()
    if wins.count() <= BROADCAST:
        grams = F.broadcast(grams)
    w = docs.select("rk", "doc_id", words(F.col("text")).alias("w")).withColumn("wh", _word_hashes("w"))
    # size(wh) rather than size(w): with one reference alone the optimizer would put wh into the lambda, to be made for each window
    each = [f"CASE WHEN size(wh) >= {k} THEN transform(sequence(1, size(wh) - {k - 1}), i -> struct(i AS i, xxhash64(slice(wh, i, {k})) AS h, {k} AS len)) ELSE array() END" for k in lens]
    own = "array(struct(0 AS i, 0L AS h, 0 AS len))"  # a row for the document itself
    rows = w.select("rk", "doc_id", "w", F.explode(F.expr(f"concat({', '.join([own, *each])})")).alias("x")).select("rk", "doc_id", "w", "x.*")
    known = rows.join(grams, (rows.h == F.col("gram")) & (rows.len == F.col("gram_len")), "left").where("i = 0 OR gram IS NOT NULL")
    scanned = saved(known.select("rk", "doc_id", F.when(F.col("i") == 0, F.size("w")).cast("long").alias("n_words"), "i", "h", F.when(F.col("i") > 0, F.expr("slice(w, i, len)")).alias("win")), "scanned")
    found = scanned.where("i > 0").join(wins, ["h", "win"])
    return scanned.where("i = 0").select("rk", "doc_id", "n_words"), found.select("rk", F.col("i").alias("start"), "len", "items")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Per row of docs: rk, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit (positions of hit words from 1).

    Null or empty text has no words and no hit; nor has any text where the benchmark is empty. Items without words have
    no window. Null ids and repeated rows each keep their row; other columns aren't read.
    """
    scanned, found = hits(keyed(docs, text, doc_id), benchmark, n, item_id)
    found = found.groupBy("rk").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1))))).alias("hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    none = F.array().cast("array<string>")
    items = F.coalesce("items", none)
    return scanned.join(found, "rk", "left").select(
        "rk",
        "doc_id",
        "n_words",
        F.when(F.col("hit").isNull(), 0).otherwise(F.size("hit")).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        F.col("hit").isNotNull().alias("contaminated"),
        "hit",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """docs without contaminated rows, or (remove="spans") with the hit words, and what follows each up to the next, cut out.

    All columns of docs are kept. Rows are as in report().
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove: documents or spans")
    rk = row_key(docs, text, doc_id)
    with scratch(docs.sparkSession):
        bad = report(docs, benchmark, n, text, doc_id, item_id).where("contaminated").select(F.col("rk").alias("__rk"), F.col("hit").alias("__hit")).dropDuplicates(["__rk"])
        bad = saved(bad, "contaminated", keep=True)
    if remove == "documents":
        return docs.join(bad, rk == bad["__rk"], "left_anti")
    pieces = F.regexp_extract_all(docs[text], F.lit(_PIECE), F.lit(0))
    left = F.filter(pieces, lambda p, i: ~F.array_contains(bad["__hit"], i + 1))
    lead = F.regexp_extract(docs[text], r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    cut = F.when(bad["__hit"].isNotNull(), F.concat(lead, F.array_join(left, ""))).otherwise(docs[text])
    return docs.join(bad, rk == bad["__rk"], "left").select(*[cut.alias(c) if c == text else docs[c] for c in docs.columns])
