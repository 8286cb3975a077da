"""Operator 1, token counts: byte-pair merging with a heap and a linked list, which counts and emits no identifiers."""

from __future__ import annotations

import heapq
import re
from functools import cache

import pyarrow as pa
from public_tokenizers import path
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, texts

SPACE = "▁"
#: Segments whose counts a Python worker remembers; beyond, it forgets the older half. Bounds memory, not results.
REMEMBERED = 400_000


class Merger:
    """Counts the pieces that a sentencepiece BPE model gives, from its merge ranks alone."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError(f"{path}: only BPE models with byte fallback, plain normalisation and no user-defined pieces are known here")
        self.prefix = SPACE if n.add_dummy_prefix else ""
        order = sorted((p for p in model.pieces if p.type == 1), key=lambda p: -p.score)
        self.rank = {p.piece: k for k, p in enumerate(order)}
        self.inside = {c for p in self.rank if len(p) > 1 for c in p}
        starts_only = all(SPACE not in p.lstrip(SPACE) for p in self.rank)
        # no piece crosses from a word into the next space, or holds a line end: merging stays within such segments
        self.segments = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if starts_only and "\n" not in self.inside else r"(?s).+")
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def merged(self, text: str) -> int:
        """Initial symbols minus merges. A heap has the adjacent pairs by rank, then from the left; prev and next link what is left."""
        rank = self.rank
        symbols = list(text)
        n = len(symbols)
        count = sum(1 if c in rank else len(c.encode()) for c in symbols)
        if n < 2:
            return count
        nxt, prev = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []
        for i in range(n - 1):
            if (r := rank.get(symbols[i] + symbols[i + 1])) is not None:
                heap.append((r, i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
        heapq.heapify(heap)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            a, b = symbols[i], symbols[j]
            if not a or not b or len(a) + len(b) != size:  # one of them has merged since
                continue
            symbols[i], symbols[j] = a + b, ""
            # a character that is no piece itself counts as its bytes until it merges
            count += 1 - (1 if a in rank else len(a.encode())) - (1 if b in rank else len(b.encode()))
            k = nxt[i] = nxt[j]
            if k >= 0:
                prev[k] = i
                if (r := rank.get(symbols[i] + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, k, size + len(symbols[k])))
            h = prev[i]
            if h >= 0 and (r := rank.get(symbols[h] + symbols[i])) is not None:
                heapq.heappush(heap, (r, h, i, size + len(symbols[h])))
        return count

    def remembered(self, segment: str) -> int:
        n = self.old.get(segment)
        if n is None:
            n = self.merged(segment)
        if len(segment) <= 64:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[segment] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, known = 0, self.young.get
        for s in self.segments.findall(self.prefix + text.replace(" ", SPACE)):
            n = known(s)
            if n is None:
                n, known = self.remembered(s), self.young.get
            total += n
        return total


@cache
def merger(path: str) -> Merger:
    """One a Python worker."""
    return Merger(path)


def count_tokens(docs: DataFrame, model: str = path("piece_bpe_32k.model"), limit: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Whole texts, without begin or end tokens. Null or empty text: 0 bytes, 0 tokens. A null id stays null, repeated
    rows each give a row, an empty table gives none, other columns aren't read. A narrow pass without a shuffle; one very
    long text takes n log n time in its task.
    """

    def make():
        m = merger(model)

        def step(b: pa.RecordBatch):
            raw = texts(b)
            n = [m.count(x.decode("utf-8", "replace")) for x in raw]
            yield pa.record_batch([b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return step

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(over_batches(make), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
