"""Operator 8, n-gram Jaccard join by chosen paths.

A document is its set of five-word shingles; documents with equal sets are one class and join once. In each of several runs
a set chooses shared tokens by a hash that depends on the path so far and on the token alone: each with probability
1 / (threshold x its size), so that a pair at the threshold agrees on one choice a level on average. Sets on one path are
a bucket. A small bucket is compared by brute force; a large one is split by a further token, up to `depth`. Runs repeat
until a pair at the threshold meets with the target recall. Candidates form groups, and within each all pairs are
compared exactly, in square blocks; only counts and spanning links leave a task, so no step emits a group's pairs.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, over_batches, released, row_key, saved, scratch, texts
from .components import components
from .repeats import _INVERSE, _MULTIPLIER, _TABLE, _upto
from .suffix_dedup import _longs, _only

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Minhashes of a sketch, and how many must agree for a pair to go on: over five deviations below 0.8.
SKETCH, AGREE = 64, 34
_SKETCH_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A bucket of so many is compared at once; a larger one is split by a token, or at the last level into squares of BLOCK.
LEAF, BLOCK, EXACT_BLOCK = 64, 2048, 512


def mixed(v: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit integers."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def shingles(text: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles. Words are runs without ASCII space, A-Z lower-cased; a text of
    fewer words has one shingle, and one without words none."""
    x = np.frombuffer(text.lower(), np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[x], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    p = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_TABLE[x] * _upto(_MULTIPLIER, len(x)), out=p[1:])
    w = mixed((p[end] - p[start]) * _upto(_INVERSE, len(x))[start] + (end - start).astype(np.uint64))
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(k, len(w)), np.uint64)
    for i in range(min(k, len(w))):
        h = mixed(h) + w[i : i + n]
    return np.unique(mixed(h))


def sketch(tokens: np.ndarray) -> bytes:
    if not len(tokens):
        return bytes(SKETCH)
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(tokens), 4096):
        t = tokens[i : i + 4096, None] * _SKETCH_MULTIPLIERS[None, :]
        least = np.minimum(least, (t ^ (t >> np.uint64(32))).min(axis=0))
    return (mixed(least) & np.uint64(255)).astype(np.uint8).tobytes()


def chosen(tokens: np.ndarray, path: int, threshold: float) -> np.ndarray:
    """The nodes below a path: each token of the set with probability 1 / (threshold x size)."""
    if not len(tokens):
        return tokens
    h = mixed(tokens ^ np.uint64(path))
    odds = 1 / (threshold * len(tokens))
    return h if odds >= 1 else h[h < np.uint64(min(odds, 1 - 2**-53) * 2.0**64)]


def runs_for(recall: float, depth: int) -> int:
    """Runs until a pair at the threshold has met at the deepest level with that probability."""
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _scan(k: int, threshold: float, runs: int):
    seeds = [int(s) for s in np.random.default_rng(23).integers(0, 1 << 63, runs)]

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            keys, sizes, nodes, sketches = [], [], [], []
            for x in texts(b):
                t = shingles(x, k)
                keys.append(xxhash.xxh3_128_digest(t.tobytes()))
                sizes.append(len(t))
                sketches.append(sketch(t))
                nodes.append(np.concatenate([chosen(t, s, threshold) for s in seeds]).view(np.int64).tolist())
            dk = np.arange(seq, seq + len(keys), dtype=np.int64) | (part << 40)
            seq += len(keys)
            names = ["rk", "dk", "doc_id", "set_key", "size", "sketch", "nodes"]
            yield pa.record_batch([b.column("rk"), pa.array(dk), b.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], names=names)

    return run


def _deeper(k: int, threshold: float):
    """(dk, node) of the nodes below those wanted."""

    def make():
        def step(b: pa.RecordBatch):
            dk, node = [], []
            for x, want in zip(texts(b), b.column("want").to_pylist(), strict=True):
                t = shingles(x, k)
                for w in want:
                    below = chosen(t, (w["node"] & (2**64 - 1)) ^ 0x5851F42D4C957F2D, threshold).view(np.int64).tolist()
                    node += below
                    dk += [w["dk"]] * len(below)
            if dk:
                yield pa.record_batch([pa.array(dk, pa.int64()), pa.array(node, pa.int64())], names=["dk", "node"])

        return step

    return over_batches(make)


def _grouped(batches, fields: tuple[str, ...]):
    """Lists of `fields` of rows sorted by g, a group at a time."""
    now, held = None, []
    for b in batches:
        cols = {c: b.column(c) for c in fields}
        g = b.column("g").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(g)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(g)], strict=True):
            if j == i:
                continue
            if now is not None and g[i] != now:
                yield held
                held = []
            now = g[i]
            held.append({c: cols[c].slice(i, j - i) for c in fields})
    if held:
        yield held


def _column(held: list[dict], name: str) -> list:
    return [x for h in held for x in h[name].to_pylist()]


def _roots(n: int, pairs: np.ndarray, dk: np.ndarray) -> np.ndarray:
    """Of n vertices, the least dk of each one's component."""
    root = dk.copy()
    while len(pairs):
        low = np.minimum(root[pairs[0]], root[pairs[1]])
        new = root.copy()
        np.minimum.at(new, pairs[0], low)
        np.minimum.at(new, pairs[1], low)
        if (new == root).all():
            break
        root = new
    return root


def _squares(members: DataFrame, block: int) -> DataFrame:
    """members: group, dk, ... -> rows with g, a hash of the group or, for a large one, of each square of blocks that dk
    belongs to, and side (0 in both, 1 or 2 in one of the two blocks)."""
    sizes = saved(members.groupBy("group").agg(F.count("*").alias("of")).where("of > 1"), "sizes")
    m = members.join(sizes, "group").withColumn("blocks", F.ceil(F.col("of") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("dk"), F.col("blocks")).cast("int"))
    square = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), F.when(o == F.col("own"), 0).when(o > F.col("own"), 1).otherwise(2).alias("side")))
    m = m.withColumn("q", F.explode(square))
    return m.withColumn("g", F.xxhash64("group", "q.i", "q.j")).withColumn("side", F.col("q.side"))


def _dealt(rows: DataFrame, spark_partitions: int) -> DataFrame:
    return rows.repartition(spark_partitions, "g").sortWithinPartitions("g", "dk")


def _candidates(threshold: float):
    """Within each bucket, links (a, b) from each set to the least set that its sketch connects it with."""

    def run(batches):
        for held in _grouped(batches, ("dk", "size", "sketch", "side")):
            dk = np.array(_column(held, "dk"), np.int64)
            size, side = np.array(_column(held, "size"), np.int64), np.array(_column(held, "side"))
            sk = np.frombuffer(b"".join(_column(held, "sketch")), np.uint8).reshape(-1, SKETCH)
            if len(dk) < 2:
                continue
            pairs = []
            for i in range(0, len(dk), 512):  # a strip of rows at a time bounds memory
                same = np.zeros((min(512, len(dk) - i), len(dk)), np.uint8)
                for c in range(SKETCH):
                    same += sk[i : i + 512, c][:, None] == sk[:, c][None, :]
                a, z = size[i : i + 512][:, None], size[None, :]
                ok = (same >= AGREE) & (np.minimum(a, z) >= threshold * np.maximum(a, z)) & ((side[i : i + 512][:, None] != side[None, :]) | (side[None, :] == 0))
                p, q = np.nonzero(ok)
                p = p + i
                pairs.append(np.stack([p, q])[:, p < q])
            pairs = np.concatenate(pairs, axis=1)
            if pairs.shape[1]:
                root = _roots(len(dk), pairs, dk)
                far = root != dk
                if far.any():
                    yield pa.record_batch([pa.array(root[far]), pa.array(dk[far])], names=["a", "b"])

    return run


def _exact(threshold: float):
    """Within each square, all pairs by their whole sets: (dk, links, docs, root)."""

    def run(batches):
        for held in _grouped(batches, ("dk", "copies", "side", "tokens")):
            dk, copies, side = (np.array(_column(held, c), np.int64) for c in ("dk", "copies", "side"))
            n = len(dk)
            if n < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in _column(held, "tokens")]
            size = np.array([len(s) for s in sets], np.int64)
            both = np.zeros((n, n), np.float32)
            if n <= 6:
                for i in range(n):
                    for j in range(i + 1, n):
                        both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            else:
                _, of, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                owner = np.repeat(np.arange(n), size)
                often = df[of] > 1
                owner, of = owner[often], (np.cumsum(df > 1) - 1)[of[often]]
                order = np.argsort(of, kind="stable")
                owner, of = owner[order], of[order]
                width = max(64, (1 << 21) // n)
                for c in range(0, int(of[-1]) + 1 if len(of) else 0, width):
                    i, j = np.searchsorted(of, [c, c + width])
                    m = np.zeros((n, width), np.float32)
                    m[owner[i:j], of[i:j] - c] = 1
                    both += m @ m.T
            union = size[:, None] + size[None, :] - both
            like = (both >= threshold * union - 1e-6) & ((side[:, None] != side[None, :]) | (side[None, :] == 0))
            np.fill_diagonal(like, False)
            links = like.sum(axis=1)
            if links.any():
                pairs = np.stack(np.nonzero(np.triu(like)))
                some = links > 0
                yield pa.record_batch([pa.array(a[some], pa.int64()) for a in (dk, links, like @ copies, _roots(n, pairs, dk))], names=["dk", "links", "docs", "root"])

    return run


def _with_tokens(k: int):
    """(dk, group, copies, tokens): each wanted document's set."""

    def make():
        def step(b: pa.RecordBatch):
            rows = [(w["dk"], w["group"], w["copies"], tokens) for x, want in zip(texts(b), b.column("want").to_pylist(), strict=True) for tokens in [shingles(x, k).tobytes()] for w in want]
            dk, group, copies, tokens = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(dk, pa.int64()), pa.array(group, pa.int64()), pa.array(copies, pa.int64()), pa.array(tokens, pa.binary())], names=["dk", "group", "copies", "tokens"])

        return step

    return over_batches(make)


def _found(docs: DataFrame, threshold: float, k: int, recall: float, depth: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(scanned: rk, doc_id, set_key, size, ...; found: set_key, class_id, set_id, copies, links, docs, class_key), both kept."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 32)
    rows = keyed(docs, text, doc_id)
    scanned = saved(rows.mapInArrow(released(_scan(k, threshold, runs_for(recall, depth))), "rk binary, dk long, doc_id long, set_key binary, size int, sketch binary, nodes array<long>"), "scanned", keep=True)
    classes = saved(scanned.groupBy("set_key").agg(F.min("dk").alias("dk"), F.count("*").alias("copies"), F.min("doc_id").alias("set_id")), "classes")
    sets = saved(scanned.join(classes.select("dk", "copies"), "dk").where("size > 0").select("dk", "rk", "size", "sketch", "copies", "nodes"), "sets")
    plain = sets.select("dk", "rk", "size", "sketch")

    # split until buckets are small
    level, small = sets.select("dk", F.explode("nodes").alias("node")).distinct(), []
    for d in range(1, depth + 1):
        counts = saved(level.groupBy("node").count().where("count > 1"), "counts")
        members = saved(level.join(counts, "node"), "members")
        small.append(members.where(F.col("count") <= LEAF) if d < depth else members)
        large = members.where(F.col("count") > LEAF)
        if d == depth or large.isEmpty():
            break
        want = large.join(plain.select("dk", "rk"), "dk").groupBy("rk").agg(F.collect_list(F.struct("dk", "node")).alias("want"))
        level = saved(_only(rows, saved(want, "want")).select("text", "want").mapInArrow(_deeper(k, threshold), "dk long, node long").distinct(), "level")
    buckets = small[0]
    for s in small[1:]:
        buckets = buckets.unionByName(s)
    squares = _squares(buckets.select(F.col("node").alias("group"), "dk"), BLOCK)
    compared = _dealt(squares.join(plain.select("dk", "size", "sketch"), "dk").select("g", "dk", "size", "sketch", "side"), parts).mapInArrow(released(_candidates(threshold)), "a long, b long")
    groups = components(saved(compared.distinct(), "candidates"))

    # all pairs of a group, exactly
    want = groups.select(F.col("v").alias("dk"), F.col("root").alias("group")).join(sets.select("dk", "rk", "copies"), "dk").groupBy("rk").agg(F.collect_list(F.struct("dk", "group", "copies")).alias("want"))
    tokens = saved(_only(rows, saved(want, "want")).dropDuplicates(["rk"]).select("text", "want").mapInArrow(_with_tokens(k), "dk long, group long, copies long, tokens binary"), "sets")
    pairs = _dealt(_squares(tokens, EXACT_BLOCK).select("g", "dk", "copies", "side", "tokens"), parts).mapInArrow(released(_exact(threshold)), "dk long, links long, docs long, root long")
    pairs = saved(pairs, "links")
    links = pairs.groupBy("dk").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    roots = components(pairs.select(F.col("root").alias("a"), F.col("dk").alias("b"))).select(F.col("v").alias("dk"), "root")
    found = classes.join(links, "dk", "left").join(roots, "dk", "left").withColumn("root", F.coalesce("root", "dk"))
    found = saved(found, "found", keep=True)
    named = found.groupBy("root").agg(F.min("set_id").alias("class_id"))
    found = found.join(named, "root").select("set_key", "class_id", "set_id", "copies", "links", "docs", F.col("root").alias("class_key"))
    return scanned, found


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9999, depth: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: rk, doc_id, class_id, set_id, n_shingles, n_links, n_text_links, class_key (never null).

    set_id: the least doc_id of those with an equal shingle set. class_id: the least doc_id of all that a chain of links
    joins. n_text_links: other sets at Jaccard >= threshold; n_links: other documents, copies counted. Null, empty or
    blank texts have no shingle and are one another's copies. Repeated rows are copies. Null ids keep their row and
    give way to any id in set_id and class_id; an empty table gives none; other columns aren't read.
    """
    with scratch(docs.sparkSession):
        scanned, found = _found(docs, threshold, k, recall, depth, text, doc_id)
    zero = F.lit(0).cast("long")
    return scanned.select("rk", "doc_id", "set_key", "size").join(found, "set_key").select(
        "rk",
        "doc_id",
        "class_id",
        "set_id",
        F.col("size").cast("long").alias("n_shingles"),
        (F.coalesce("docs", zero) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("links", zero).alias("n_text_links"),
        "class_key",
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each class: that of its least doc_id (a null id only where there is no other). All columns stay.

    The least is found by a map-side minimum, so that a class of any size is a row a task.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk"))
    with scratch(docs.sparkSession):
        found = jaccard_classes(docs, text=text, doc_id=doc_id, **options)
        kept = saved(found.groupBy("class_key").agg(first.alias("first")).select(F.col("first.rk").alias("__rk")), "kept", keep=True)
    key = f"rk_{uuid.uuid4().hex}"  # no column of docs
    own = docs.withColumn(key, row_key(docs, text, doc_id))
    return own.join(kept, own[key] == kept["__rk"], "left_semi").dropDuplicates([key]).select(*docs.columns)
