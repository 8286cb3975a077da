"""Slices of source text: what a file's flagged statements look like with the functions around them, and nothing else."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A node of a file's syntax tree: bytes [start, end) of the UTF-8 text. A function or class has the place after its opening
#: brace (head) and that of its closing one (foot); others have nulls there. hit: flagged; info: what is said of it.
NODE = "struct<start int, end int, head int, foot int, hit boolean, info array<string>>"


def render(source: str, nodes: list[dict]) -> str:
    """The slice of one file.

    A function or class shows its head, what it holds that is flagged or holds flagged nodes, each on lines of its own, and
    its foot; any other node is shown whole, with the nodes inside it in their own form. Infos follow in a comment on the last
    line; nodes of one range are one node. A function or class is itself no hit, and nothing is shown of one without hits.
    Ranges that cross an earlier one's end, or lie outside the text, are passed over.
    """
    text = source.encode()
    merged: dict[tuple[int, int], dict] = {}
    for n in nodes:
        if n["start"] is None or n["end"] is None or not 0 <= n["start"] < n["end"] <= len(text):
            continue
        m = merged.setdefault((n["start"], n["end"]), {"scope": None, "hit": False, "info": []})
        if n["head"] is not None and n["foot"] is not None and n["start"] < n["head"] <= n["foot"] < n["end"]:
            m["scope"] = (n["head"], n["foot"])
        m["hit"] |= bool(n["hit"]) and n["head"] is None
        m["info"] = list(dict.fromkeys([*m["info"], *(x for x in (n["info"] if n["info"] is not None else []) if x is not None)]))
    ranges = sorted(merged, key=lambda r: (r[0], -r[1]))
    inside: dict[tuple[int, int] | None, list[tuple[int, int]]] = {None: []}
    around: list[tuple[int, int]] = []
    for r in ranges:
        while around and around[-1][1] <= r[0]:
            around.pop()
        if around and r[1] > around[-1][1]:
            continue
        inside[around[-1] if around else None].append(r)
        inside[r] = []
        around.append(r)
    shown: dict[tuple[int, int], str] = {}
    for r in reversed([r for r in ranges if r in inside]):  # what is inside comes before what is around
        kept = [c for c in inside[r] if c in shown]
        m = merged[r]
        if not (kept or m["hit"]):
            continue
        if m["scope"] and kept:
            out = "\n".join([_cut(text, r[0], m["scope"][0]), *(" " * _column(text, c[0]) + shown[c] for c in kept), _cut(text, m["scope"][1], r[1])])
        else:
            parts, at = [], r[0]
            for c in kept:
                parts += [_cut(text, at, c[0]), shown[c]]
                at = c[1]
            out = "".join([*parts, _cut(text, at, r[1])])
        shown[r] = f"{out} // {', '.join(m['info'])}" if m["info"] else out
    lines = "\n".join(shown[r] for r in inside[None] if r in shown).split("\n")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in lines))


def _cut(text: bytes, start: int, end: int) -> str:
    return text[start:end].decode("utf-8", "replace")


def _column(text: bytes, at: int) -> int:
    return at - text.rfind(b"\n", 0, at) - 1


def rendered(source: Column, nodes: Column) -> Column:
    """render() of each row's text and nodes, an array of NODE. Null text or nodes: null; no hit: empty."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, trees in batches:
            yield pd.Series([None if x is None or t is None else render(x, [_whole(n) for n in t]) for x, t in zip(texts, trees, strict=True)], dtype=object)

    return run(source, nodes.cast(f"array<{NODE}>"))


def _whole(node: dict | None) -> dict:
    """Numbers as int; a null node is one without a range."""
    n = node or dict.fromkeys(("start", "end", "head", "foot", "hit", "info"))
    return {k: (None if v is None or v != v else int(v)) if k in ("start", "end", "head", "foot") else v for k, v in ((k, n[k]) for k in ("start", "end", "head", "foot", "hit", "info"))}
