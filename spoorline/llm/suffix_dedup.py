"""Operator 2, suffix-array dedup: a depth-limited radix sort of suffixes by most-significant-digit passes.

Suffixes are ordered only through their first `size` bytes, and leave as soon as their group has one member; the groups left
at the end are exactly the repeated windows. The first digit is one that any place of a window's bytes may give: its
minimiser, the gram of least hash. Neighbouring windows share it and travel as one run, so that the text is dealt into buckets
without a row for each suffix; equal runs of a bucket are settled at once, and one of each kind goes on with its bytes. Within
a bucket the passes go from left to right, eight bytes a digit, through the threshold: equality is that of the bytes. A bucket
of more than FEW kinds isn't gathered in a task: two distributed digits split it first (what all windows of a block of 32
share, then single windows), which are counted map-side.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom, suspected
from .common import broadcast, keyed, over_batches, released, saved, scratch, texts
from .repeats import runs

#: Windows of a block, by which a hot bucket is split; kinds of runs of a bucket that is sorted in one task; windows sorted at once.
BLOCK, FEW, AT_ONCE = 32, 2048, 1 << 19
#: Rows of a key beyond which it is told by a small table of such keys, that Spark broadcasts by its size, rather than by a shuffle.
HOT = 10_000


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64), pa.int64())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), _longs(np.concatenate(parts) if parts else np.zeros(0, np.uint64)))


def _hash(data: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(data, seed)


def _scan(size: int):
    """A row a document: its bytes, digest, and each run's gram, hash, first window and, from there, anchor. dk numbers rows; the table is stored before use."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            n, sha, grams, whole, first, rel = [], [], [], [], [], []
            for x in texts(b):
                lo, hi, at, g = runs(x, size)
                n.append(len(x))
                sha.append(hashlib.sha256(x).hexdigest())
                grams.append(g)
                whole.append(np.fromiter((_hash(x[i : j + size], 0) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(lo)))
                first.append(lo.astype(np.uint64))
                rel.append((at - lo).astype(np.uint64))
            if n:
                dk = np.arange(seq, seq + len(n), dtype=np.uint64) | np.uint64(part << 40)
                seq += len(n)
                small = lambda parts, t: _lists(parts).cast(pa.list_(t))
                cols = [b.column("rk"), _longs(dk), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), _lists(grams), _lists(whole), small(first, pa.int32()), small(rel, pa.int16())]
                yield pa.record_batch(cols, names=["rk", "dk", "doc_id", "n_bytes", "sha", "grams", "runs", "first", "rel"])

    return run


def _grams(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column("grams").flatten().to_numpy(zero_copy_only=False).view(np.uint64)]


def _repeated_runs(bits, size: int):
    """(gram, run, dk, s, e, o) of runs whose gram may be seen twice: windows s..e, the anchor at s + o."""

    def make():
        known = bits.value

        def step(b: pa.RecordBatch):
            g, w, lo, rel = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("grams", "runs", "first", "rel"))
            count = b.column("grams").value_lengths().to_numpy(zero_copy_only=False)
            if not len(g):
                return
            dk = np.repeat(b.column("dk").to_numpy(zero_copy_only=False), count)
            hi = np.append(lo[1:], 0) - 1  # runs follow one another, the last ends with the text
            last = np.cumsum(count)[count > 0] - 1
            hi[last] = b.column("n_bytes").to_numpy(zero_copy_only=False)[count > 0] - size
            hit = suspected(known, g.view(np.uint64))
            if hit.any():
                cols = ((g, pa.int64()), (w, pa.int64()), (dk, pa.int64()), (lo, pa.int32()), (hi, pa.int32()), (rel, pa.int16()))
                yield pa.record_batch([pa.array(a[hit], t) for a, t in cols], names=["gram", "run", "dk", "s", "e", "o"])

        return step

    return over_batches(make)


def _rk_hash(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64, 1) for x in b.column("rk").to_pylist()]


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs joined with wanted (rk, ...); a filter of fixed size keeps most other texts out of the shuffle."""
    bits = broadcast(docs.sparkSession, bloom(wanted.select("rk"), _rk_hash, "once"))

    def make():
        known = bits.value

        def step(b: pa.RecordBatch):
            hit = suspected(known, np.concatenate(_rk_hash(b)))
            if hit.any():
                yield b.filter(pa.array(hit))

        return step

    return docs.mapInArrow(over_batches(make), "rk binary, doc_id long, text string").join(wanted, "rk")


def _blocks(anchor: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(block, first, last window start) of a run. Blocks count by the anchor's place in the window, so that they are alike in all texts."""
    out, s = [], lo
    while s <= hi:
        b = (anchor - s) // BLOCK
        last = min(hi, anchor - b * BLOCK)
        out.append((b, s, last))
        s = last + 1
    return out


def _with_bytes(size: int):
    """(gram, n, dk, s, e, o, data): the runs wanted, with their bytes."""

    def make():
        def step(b: pa.RecordBatch):
            rows = [(w["gram"], w["n"], w["dk"], w["s"], w["e"], w["o"], x[w["s"] : w["e"] + size]) for x, want in zip(texts(b), b.column("want").to_pylist(), strict=True) for w in want]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["gram", "n", "dk", "s", "e", "o", "data"])

        return step

    return over_batches(make)


def equal_through(data: np.ndarray, start: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """Which suffixes data[start:] have an equal through `size` bytes in their group, by most-significant-digit passes of eight bytes.

    The suffixes stay in order of the digits so far. A pass leaves a group alone where all its digits are one, sorts it by the
    digit where not, and takes out who is alone in its group then.
    """
    out = np.zeros(len(start), bool)
    words = np.ndarray((max(0, len(data) - 7),), np.uint64, buffer=data, strides=(1,))
    live = np.argsort(group, kind="stable")
    g = group[live]
    for at in [*range(0, size - 7, 8), *([size - 8] if size % 8 else []), None]:
        new = np.ones(len(live), bool)
        new[1:] = g[1:] != g[:-1]
        alone = new & np.append(new[1:], True)
        if alone.any():
            live, g, new = live[~alone], g[~alone], new[~alone]
        if at is None or not len(live):
            break
        digit, g = words[start[live] + at], np.cumsum(new)
        mixed = np.zeros(g[-1] + 1, bool)
        mixed[g[1:][~new[1:] & (digit[1:] != digit[:-1])]] = True
        if mixed.any():
            some = np.flatnonzero(mixed[g])
            order = some[np.lexsort((digit[some], g[some]))]
            live[some], digit[some] = live[order], digit[order]
            new[1:] |= digit[1:] != digit[:-1]
            g = np.cumsum(new)
    out[live] = True
    return out


def _sorted(size: int):
    """Rows by gram -> (dk, s, e): runs of windows that others of the bucket equal. Whole buckets are sorted, some at once."""

    def run(batches):
        held: list[tuple] = []
        n = 0

        def found():
            grams = np.array([h[0] for h in held], np.int64)
            data = np.frombuffer(b"".join(h[5] for h in held), np.uint8)
            n_win = np.array([h[3] - h[2] + 1 for h in held], np.int64)
            base = np.cumsum([0, *(len(h[5]) for h in held[:-1])])
            row = np.repeat(np.arange(len(held)), n_win)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
            bucket = np.cumsum(np.append(False, grams[1:] != grams[:-1]))
            offset = np.array([h[4] for h in held], np.int64)[row] - inner  # the anchor's place in the window: equal in equal windows
            hit = equal_through(data, base[row] + inner, bucket[row] * 65536 + offset, size)
            edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
            cut = np.zeros(len(row) + 1, bool)
            cut[np.cumsum(n_win)[:-1]] = True  # spans end with their run
            inside = np.append(hit, False) & np.append(False, hit) & cut
            first = np.flatnonzero((edge == 1) | inside)
            last = np.flatnonzero((edge == -1) | inside) - 1
            if len(first):
                own = row[first]
                dk, s = np.array([h[1] for h in held], np.int64)[own], np.array([h[2] for h in held], np.int64)[own]
                yield pa.record_batch([pa.array(dk), pa.array((s + inner[first]).astype(np.int32)), pa.array((s + inner[last]).astype(np.int32))], names=["dk", "s", "e"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("gram", "dk", "s", "e", "o", "data")), strict=True):
                if n > AT_ONCE and held[-1][0] != r[0]:
                    yield from found()
                    held, n = [], 0
                held.append(r)
                n += r[3] - r[2] + 1
        if held:
            yield from found()

    return run


def _block_rows(size: int):
    """A hot bucket's next digit: (gram, b, core, whole, dk, s, e, run_s) of each run's blocks."""

    def make():
        def step(b: pa.RecordBatch):
            rows = []
            for g, dk, s, e, o, x in zip(*(b.column(c).to_pylist() for c in ("gram", "dk", "s", "e", "o", "data")), strict=True):
                for k, lo, hi in _blocks(s + o, s, e):
                    # what all windows of the full block share, and what those of this run's part of it cover
                    core = _hash(x[o - k * BLOCK : o - k * BLOCK - BLOCK + 1 + size], k + 1)
                    whole = _hash(x[lo - s : hi - s + size], (s + o - lo) * 65536 + (s + o - hi) + 1)
                    rows.append((g, k, core, whole, dk, lo, hi, s))
            if rows:
                g, k, core, whole, dk, lo, hi, s = zip(*rows, strict=True)
                cols = [pa.array(g, pa.int64()), pa.array(k, pa.int32()), _longs(np.array(core, np.uint64)), _longs(np.array(whole, np.uint64)), pa.array(dk, pa.int64()), *(pa.array(c, pa.int32()) for c in (lo, hi, s))]
                yield pa.record_batch(cols, names=["gram", "b", "core", "whole", "dk", "s", "e", "run_s"])

        return step

    return over_batches(make)


def _window_rows(size: int):
    """The last digit of a hot bucket: (gram, core, o, h, dk, s) of each window of the blocks wanted."""

    def make():
        def step(b: pa.RecordBatch):
            rows = []
            for g, core, dk, s, o, x, lo, hi in zip(*(b.column(c).to_pylist() for c in ("gram", "core", "dk", "s", "o", "data", "lo", "hi")), strict=True):
                rows += [(g, core, s + o - i, _hash(x[i - s : i - s + size], 0), dk, i) for i in range(lo, hi + 1)]
            g, core, o, h, dk, s = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(g, pa.int64()), pa.array(core, pa.int64()), pa.array(o, pa.int32()), _longs(np.array(h, np.uint64)), pa.array(dk, pa.int64()), pa.array(s, pa.int32())], names=["gram", "core", "o", "h", "dk", "s"])

        return step

    return over_batches(make)


def _cut(size: int, with_text: bool):
    """Union of the repeated windows of a text, and what is left without it."""

    def make():
        def step(b: pa.RecordBatch):
            rows = []
            found = b.column("found")
            spans = found.flatten()
            first, last = spans.field("s").to_numpy(zero_copy_only=False), spans.field("e").to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *found.value_lengths().to_numpy(zero_copy_only=False)])
            for x, i, j in zip(texts(b), ends[:-1], ends[1:], strict=True):
                edge = np.zeros(len(x) + 1, np.int32)
                np.add.at(edge, first[i:j], 1)
                np.add.at(edge, last[i:j] + size, -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = np.frombuffer(x, np.uint8)[~gone].tobytes()
                starts = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                rows.append((len(x), len(x) - len(left), starts, hashlib.sha256(left).hexdigest(), left if with_text else None))
            n, k, spans, sha, left = zip(*rows, strict=True)
            yield pa.record_batch([b.column("rk"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.binary())], names=["rk", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

        return step

    return over_batches(make)


def _repeated(rows: DataFrame, counts: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is counted (key, n) more than once. Hot keys' rows aren't shuffled, so that none lands in one task."""
    few = rows.join(counts.where((F.col("n") > 1) & (F.col("n") <= HOT)).select(*key), key, "left_semi")
    hot = saved(counts.where(F.col("n") > HOT).select(*key), "hot")
    if hot.isEmpty():
        return few
    cold = rows.join(hot, key, "left_anti").join(counts.where((F.col("n") > 1) & (F.col("n") <= HOT)).select(*key), key, "left_semi")
    return cold.unionByName(rows.join(hot, key, "left_semi"))


def _of_hot(runs: DataFrame, size: int) -> DataFrame:
    """(dk, s, e) of repeated windows in buckets of many kinds, by two distributed digits more; no bucket is gathered."""
    blocks = saved(runs.mapInArrow(_block_rows(size), "gram long, b int, core long, whole long, dk long, s int, e int, run_s int"), "blocks")
    digit = ["gram", "b", "core"]
    kinds = saved(blocks.groupBy(*digit, "whole").agg(F.count("*").alias("n"), F.min(F.struct("dk", "s", "e", "run_s")).alias("at")), "block_kinds")
    alike = _repeated(blocks, kinds, [*digit, "whole"]).select("dk", "s", "e")
    mixed = saved(kinds.groupBy(*digit).count().where("count > 1").select(*digit), "mixed_blocks")
    places = kinds.join(mixed, digit, "left_semi").select("core", "at.dk", F.col("at.run_s").alias("s"), F.col("at.s").alias("lo"), F.col("at.e").alias("hi"))
    windows = saved(places.join(runs.select("gram", "dk", "s", "o", "data"), ["dk", "s"]).mapInArrow(_window_rows(size), "gram long, core long, o int, h long, dk long, s int"), "windows")
    counts = saved(windows.groupBy("gram", "core", "o", "h").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    single = _repeated(windows, counts, ["gram", "core", "o", "h"]).select("dk", "s", F.col("s").alias("e"))
    return alike.unionByName(single)


def repeated_spans(docs: DataFrame, size: int = 400) -> tuple[DataFrame, DataFrame]:
    """docs as keyed() gives them -> (scanned: rk, dk, doc_id, n_bytes, sha; found: rk, found: array of (s, e), the starts of
    repeated windows from s to e)."""
    with scratch(docs.sparkSession):
        scanned = saved(docs.mapInArrow(released(_scan(size)), "rk binary, dk long, doc_id long, n_bytes long, sha string, grams array<long>, runs array<long>, first array<int>, rel array<short>"), "scanned", keep=True)
        names = scanned.select("rk", "dk")
        bits = broadcast(docs.sparkSession, bloom(scanned.select("grams"), _grams, "twice"))
        each = saved(scanned.select("dk", "n_bytes", "grams", "runs", "first", "rel").mapInArrow(_repeated_runs(bits, size), "gram long, run long, dk long, s int, e int, o short"), "runs")
        # buckets, and in each the kinds of runs with one place of each
        kinds = saved(each.groupBy("gram", "run").agg(F.count("*").alias("n"), F.min(F.struct("dk", "s", "e", "o")).alias("at")), "kinds")
        whole = _repeated(each, kinds, ["gram", "run"]).select("dk", "s", "e")
        mixed = saved(kinds.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "mixed")
        places = kinds.select("gram", "at").join(mixed, "gram").select("gram", "n", "at.*")
        wanted = saved(places.join(names, "dk").groupBy("rk").agg(F.collect_list(F.struct("gram", "n", "dk", "s", "e", "o")).alias("want")), "wanted")
        data = saved(_only(docs, wanted).select("text", "want").mapInArrow(_with_bytes(size), "gram long, n long, dk long, s int, e int, o short, data binary"), "run_bytes")
        few = data.where(F.col("n") <= FEW).select("gram", "dk", "s", "e", "o", "data").repartition("gram").sortWithinPartitions("gram")
        equal = saved(few.mapInArrow(released(_sorted(size)), "dk long, s int, e int"), "equal")
        found = whole.unionByName(equal)
        hot = data.where(F.col("n") > FEW)
        if not hot.isEmpty():
            found = found.unionByName(_of_hot(hot, size))
        found = saved(found.join(names, "dk").groupBy("rk").agg(F.collect_list(F.struct("s", "e")).alias("found")), "found", keep=True)
        return scanned.select("rk", "dk", "doc_id", "n_bytes", "sha"), found


def remove_repeats(docs: DataFrame, size: int = 400, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with with_text also rk and the kept bytes.

    Every byte that a `size`-byte string covers which also starts anywhere else goes: in another row or the same, overlaps
    included, judged on the input. Null or empty text has no bytes; texts under `size` bytes stay. Repeated rows are
    copies of each other. Null ids keep their row; an empty table gives none; other columns aren't read.
    """
    rows = keyed(docs, text, doc_id)
    scanned, found = repeated_spans(rows, size)
    out = "rk binary, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    cut = _only(rows, found).select("rk", "doc_id", "text", "found").mapInArrow(_cut(size, with_text), out)
    zero = F.lit(0).cast("long")
    same = scanned.join(found, "rk", "left_anti")
    if with_text:
        same = rows.join(found.select("rk"), "rk", "left_anti").select("rk", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
        return cut.unionByName(same)
    same = same.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return cut.drop("rk", "kept").unionByName(same)
