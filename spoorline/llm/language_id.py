"""Operator 5, language ID: text likelihood, declared language, address and host priors, fused by Bayes' rule."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast, over_batches, released, saved, scratch

#: Bins of hashed character trigrams.
BINS = 1 << 14
_LETTERS = re.compile(r"[^\W\d_]+")
_DROPPED = re.compile(r"(?i)<(?:!--|(script|style|noscript|template)\b)")
_END = {"": re.compile("-->"), **{k: re.compile(rf"(?i)</{k}\s*>") for k in ("script", "style", "noscript", "template")}}
_TAG = re.compile(r"(?s)<[^>]*>")
_HTML, _META = re.compile(r"(?i)<html\b"), re.compile(r"(?i)<meta\b")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})")
_EQUIV = re.compile(r"(?i)http-equiv\s*=\s*[\"']?content-language[\"']?")
_CONTENT = re.compile(r"(?i)content\s*=\s*[\"']?([a-z]{2,3})")


def visible(page: str) -> str:
    """A page's text: without comments, scripts and the like, then without tags. Linear in the page, whatever stays open."""
    out, at, open_ = [], 0, set()
    for m in _DROPPED.finditer(page):
        kind = (m[1] or "").lower()
        if m.start() < at or kind in open_:
            continue
        end = _END[kind].search(page, m.end())
        if end is None:
            open_.add(kind)  # nothing closes this one, nor any later one of its kind
            continue
        out.append(page[at : m.start()])
        at = end.end()
    text = " ".join([*out, page[at:]])
    last = text.rfind(">") + 1  # what follows the last end of a tag is no tag
    return entities.unescape(_TAG.sub(" ", text[:last]) + text[last:])


def _tags(page: str, opener: re.Pattern) -> Iterator[str]:
    """What stands in each tag, up to its end or the page's; a tag within another isn't looked at again."""
    at = 0
    while m := opener.search(page, at):
        end = page.find(">", m.end())
        at = len(page) if end < 0 else end
        yield page[m.end() : at]


def declared(page: str) -> str | None:
    """The language that the html tag declares, else that of a meta tag."""
    for tag in _tags(page, _HTML):
        if found := _LANG.search(tag):
            return found[1].lower()
    for tag in _tags(page, _META):
        if (equiv := _EQUIV.search(tag)) and (found := _CONTENT.search(tag, equiv.end())):
            return found[1].lower()
    return None


def address(url: str) -> tuple[str, str, str, str | None]:
    """host, domain (its last two labels), suffix (its last), and the first part of the path if it looks like a language."""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").rstrip(".")
    except ValueError:
        return "", "", "", None
    labels = host.split(".")
    first = next((p for p in u.path.split("/") if p), "").lower()
    return host, ".".join(labels[-2:]), labels[-1], first[:2] if re.fullmatch(r"[a-z]{2}(-[a-z]{2})?", first) else None


def trigrams(text: str) -> np.ndarray:
    """Bins of the trigrams of lower-cased words, with a space at either end."""
    x = " " + " ".join(_LETTERS.findall(text.lower())) + " "
    a = np.frombuffer(x.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    h = (a[:-2] * np.uint64(0x9E3779B97F4A7C15) + a[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + a[2:] * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(20) & np.uint64(BINS - 1)).astype(np.int64)


class TextModel:
    """Multinomial naive Bayes over hashed trigrams."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.05
        self.log = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)

    def likelihood(self, text: str, weight: int = 60) -> np.ndarray:
        """Log likelihood by language. Trigrams overlap, so that all together count as `weight` independent ones at most."""
        t = trigrams(text)
        if not len(t):
            return np.zeros(len(self.langs))
        return self.log[:, t].mean(axis=1, dtype=float) * min(len(t), weight)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> TextModel:
    """Fitted on the whole texts of all labelled documents, so that every label can be answered. Each task has counts of BINS
    numbers a language; they are summed on the executors, and at most BINS rows a language come back: the model has 64 KB for
    each language, however much text there is. Ties between languages go to the first by name."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    langs = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())  # as many rows as there are languages
    if not langs:
        return TextModel(["und"], np.zeros((1, BINS)))

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if k not in counts:
                    counts[k] = np.zeros(BINS, np.int64)
                counts[k] += np.bincount(trigrams(x), minlength=BINS)
        for k, n in counts.items():
            bins = np.flatnonzero(n)
            yield pa.record_batch([pa.array([k] * len(bins), pa.string()), pa.array(bins, pa.int32()), pa.array(n[bins])], names=["lang", "bin", "n"])

    parts = labelled.mapInArrow(released(run), "lang string, bin int, n long")
    sums = parts.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    total, place = np.zeros((len(langs), BINS)), {k: i for i, k in enumerate(langs)}
    total[[place[k] for k in sums.column("lang").to_pylist()], sums.column("bin").to_numpy()] = sums.column("n").to_numpy()
    return TextModel(langs, total)


def _softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def identify(pages: DataFrame, model: TextModel, trust: float = 0.9, strength: float = 5.0, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """Per row of pages: page_id, lang, p_lang, text_lang, p_text, declared, path_lang, host, n_host.

    A page's log posterior is the sum of its text likelihood, log P(declared | language), log P(first path part | language)
    and log P(suffix | language) as aggregated over all pages, and its host's prior. A declaration is right with probability
    `trust`; one in an unknown language says nothing. Host counts are expected languages by text and declaration, summed by host,
    domain and overall without the page itself; each level has `strength` pages of the one above it added. Null or empty html
    and url leave the other evidence, and without any the overall prior; a tie goes to the first language. Null ids and
    repeated rows each keep their row; an empty table gives none; other columns aren't read.
    """
    langs, n = model.langs, len(model.langs)
    shared = broadcast(pages.sparkSession, model)  # 64 KB a language

    def said(values: list[str | None]) -> np.ndarray:
        out = np.zeros((len(values), n))
        for i, v in enumerate(values):
            if v in langs and n > 1:
                out[i] = np.log((1 - trust) / (n - 1))
                out[i, langs.index(v)] = np.log(trust)
        return out

    def read():
        m = shared.value

        def step(b: pa.RecordBatch):
            rows = []
            for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                host, domain, suffix, path = address(u or "")
                like = m.likelihood(visible(h or ""))
                d = declared(h or "")
                rows.append((host, domain, suffix, path, d, like.tolist(), _softmax(like + said([d])[0]).tolist()))
            kinds = (*[pa.string()] * 5, pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.record_batch([b.column("page_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["page_id", "host", "domain", "suffix", "path", "declared", "like", "p"])

        return step

    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    seen = saved(narrow.mapInArrow(over_batches(read), "page_id long, host string, domain string, suffix string, path string, declared string, like array<double>, p array<double>"), "pages")
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]
    packed = F.array(*[f"s{i}" for i in range(n)])
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    with scratch(pages.sparkSession):
        by_host = saved(seen.groupBy("host", "domain", "suffix").agg(*sums), "hosts")  # map-side first: a hot host is a row a task
        by_domain = saved(by_host.groupBy("domain").agg(*again).select("domain", packed.alias("of_domain")), "domains")
        by_suffix = saved(by_host.groupBy("suffix").agg(*again).select("suffix", packed.alias("of_suffix")), "suffixes")
        whole = by_host.agg(*again).first()
        known = by_host.select("host", "domain", "suffix", packed.alias("of_host")).join(by_domain, "domain").join(by_suffix, "suffix")
        known = saved(known.select("host", "of_host", "of_domain", "of_suffix"), "known", keep=True)
    overall = np.array([x or 0.0 for x in whole]) if whole else np.zeros(n)
    path_rows = seen.where(F.col("path").isin(langs)).groupBy("path").agg(*sums).collect()  # a row for each language at most
    on_path = {r["path"]: np.array(r[1:]) for r in path_rows}
    prior = (overall + 1) / (overall + 1).sum()
    path_log = {k: np.log((v + 0.5) / (overall + 0.5 * (n + 1))) for k, v in on_path.items()}

    joined = seen.join(known, "host")

    def fuse():
        def step(b: pa.RecordBatch):
            a = {c: np.array(b.column(c).to_pylist(), float).reshape(-1, n) for c in ("like", "p", "of_host", "of_domain", "of_suffix")}
            path, said_lang = b.column("path").to_pylist(), b.column("declared").to_pylist()
            less = lambda v: np.maximum(v - a["p"], 0)
            domain, host = less(a["of_domain"]), less(a["of_host"])
            at_domain = (domain + strength * prior) / (domain.sum(axis=1, keepdims=True) + strength)
            at_host = (host + strength * at_domain) / (host.sum(axis=1, keepdims=True) + strength)
            suffix = np.log((less(a["of_suffix"]) + 1) / (np.maximum(overall - a["p"], 0) + 2))
            path_part = np.stack([path_log[p] if p in path_log else np.zeros(n) for p in path])
            post = _softmax(a["like"] + said(said_lang) + path_part + suffix + np.log(at_host))
            text = _softmax(a["like"])
            best, best_text = post.argmax(axis=1), text.argmax(axis=1)
            rows = np.arange(len(best))
            cols = [b.column("page_id"), pa.array([langs[i] for i in best]), pa.array(post[rows, best]), pa.array([langs[i] for i in best_text]), pa.array(text[rows, best_text]), b.column("declared"), b.column("path"), b.column("host"), pa.array(np.rint(a["of_host"].sum(axis=1)).astype(np.int64))]
            yield pa.record_batch(cols, names=["page_id", "lang", "p_lang", "text_lang", "p_text", "declared", "path_lang", "host", "n_host"])

        return step

    return joined.select("page_id", "host", "path", "declared", "like", "p", "of_host", "of_domain", "of_suffix").mapInArrow(over_batches(fuse), "page_id long, lang string, p_lang double, text_lang string, p_text double, declared string, path_lang string, host string, n_host long")
