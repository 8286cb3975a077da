"""Each operator against a brute-force version, and on the odd rows of conftest.py."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from spoorline.llm import jaccard_join, language_id, license_scan, quality_classifier, quality_rules, suffix_dedup
from spoorline.llm.decontaminate import decontaminate, report
from spoorline.llm.jaccard_join import jaccard_classes, keep_one, shingles
from spoorline.llm.line_dedup import dedup_lines, line_keys, without_repeats
from spoorline.llm.packing import pack, sequences, token_ids
from spoorline.llm.suffix_dedup import remove_repeats
from spoorline.llm.token_count import count_tokens, merger


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# 1


def test_token_counts_equal_the_library(spark, odd, docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    for df in (odd, docs):
        want = sorted(((d, len(x.encode()), n, n > 4096) for d, x in pairs(df) for n in [len(sp.encode(x))]), key=repr)
        assert rows(count_tokens(df), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert count_tokens(empty).count() == 0


def test_merging_of_odd_strings():
    import sentencepiece

    m, sp = merger(path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    r, parts = random.Random(3), [*"  \n\t▁abcthe入é\0ñ😀<s>0x", "the", "ing", " a", " ▁"]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randrange(40)))
        assert m.count(x) == len(sp.encode(x)), repr(x)


# 2


def without_windows(data, size):
    seen = Counter(x[s : s + size] for _, x in data for s in range(len(x) - size + 1))
    out = []
    for d, x in data:
        gone = np.zeros(len(x), bool)
        for s in range(len(x) - size + 1):
            if seen[x[s : s + size]] > 1:
                gone[s : s + size] = True
        left = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((d, len(x), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


COLS2 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup_equals_all_windows(spark, odd, docs, empty):
    assert rows(remove_repeats(docs), *COLS2) == without_windows([(d, x.encode()) for d, x in pairs(docs)], 400)
    assert rows(remove_repeats(odd), *COLS2) == without_windows([(d, x.encode()) for d, x in pairs(odd)], 400)
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("few,hot", [(2048, 10_000), (1, 10_000), (1, 3), (2048, 1)])
def test_suffix_dedup_of_shared_passages(spark, monkeypatch, few, hot):
    monkeypatch.setattr(suffix_dedup, "FEW", few)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = [word(n) for n in (399, 400, 401, 700, 2500)]
    data = [(i, word(r.randrange(300)) + r.choice(shared) + word(r.randrange(600)) + (r.choice(shared)[: r.randrange(900)])) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    assert rows(remove_repeats(df), *COLS2) == without_windows([(d, x.encode()) for d, x in data], 400)
    kept = {x.doc_id: x for x in remove_repeats(df, with_text=True).collect()}
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in kept.values()) and len(kept) == 60


def test_digit_passes_equal_a_table_of_windows():
    r = np.random.default_rng(0)
    for size, kinds in ((8, 2), (9, 3), (23, 1), (40, 2)):
        data = np.tile(r.integers(0, kinds, 400, dtype=np.uint8), 3)
        data[r.integers(0, len(data), 5)] = 9
        start = np.arange(len(data) - size + 1)
        group = start % 3
        seen = Counter((g, data[s : s + size].tobytes()) for s, g in zip(start, group, strict=True))
        want = [seen[g, data[s : s + size].tobytes()] > 1 for s, g in zip(start, group, strict=True)]
        assert suffix_dedup.equal_through(data, start, group, size).tolist() == want


@pytest.mark.parametrize("fan,bits", [(256, 18), (2, 18), (2, 20)])
def test_filters_merge_in_a_tree(spark, fan, bits):
    from spoorline.llm import bloom

    h = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    df = spark.createDataFrame([(int(x) - (1 << 63),) for x in [*h, *h[:500]]], "h long").repartition(7)
    read = lambda b: [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)]
    once, twice = (bloom.bloom(df, read, k, bits, fan) for k in ("once", "twice"))
    assert once.shape == (512, (1 << bits) // 8) and bloom.suspected(once, h).all() and bloom.suspected(twice, h[:500]).all()
    assert bloom.suspected(twice, h[500:]).mean() < 0.01 and bloom.suspected(once, h + np.uint64(1)).mean() < 0.02


# 3


@pytest.mark.parametrize("targets,alpha", [(None, 1.0), (None, 0.5), ({"src1": 3.0, "src2": 0.1}, 1.0), ({"src1": 2.0, "src2": 0.0, "src3": 0}, 1.0), ({"": 0.0}, 1.0)])
def test_packing_holds_each_id_once(spark, odd, docs, empty, targets, alpha):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for df in (docs, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        ids = {d: [*t.encode(x, add_special_tokens=False).ids, 0] for d, x in pairs(df)}
        out = pack(df, targets, alpha, with_ids=True)
        got = defaultdict(list)
        used = defaultdict(list)
        for p in out.collect():
            got[p.doc_id].append(p)
            used[p.sequence_id].append((p.offset, p.length))
        assert got.keys() == ids.keys()
        for d, ps in got.items():
            at = 0
            for p in sorted(ps, key=lambda p: p.start):
                own = ids[d][p.start : p.start + p.length]
                assert p.start == at and p.ids == own and p.doc_tokens == len(ids[d]) and p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
                at += p.length
            assert at == len(ids[d])
        full = 0
        for ps in used.values():
            at = 0
            for offset, length in sorted(ps):
                assert offset == at
                at += length
            full += at == 1024
        assert full >= len(used) - 1 and sorted(used) == list(range(len(used)))
        assert sequences(out).where("size(ids) <> 1024").count() == 0
    assert pack(empty).count() == 0 and pack(odd).count() >= odd.count()


def test_packing_keeps_proportions(spark, docs):
    window = 16 * 1024
    out = pack(docs, window=window).toPandas()
    share = out.groupby("queue").length.sum() / out.length.sum()
    by = out.groupby([out.sequence_id // 16, "queue"]).length.sum().unstack(fill_value=0)
    assert (by.cumsum().sub(np.outer(by.sum(axis=1).cumsum(), share)).abs().to_numpy().max()) <= 3 * 1024


def test_packing_meets_targets_until_a_source_runs_dry(spark, docs):
    """Every window of 16 sequences has each source's target share within two quanta, as long as all sources last; sources without weight come last."""
    sources = sorted(r.source for r in docs.select("source").distinct().collect())
    targets = {s: float(k % 3) for k, s in enumerate(sources)}
    out = pack(docs, targets, window=16 * 1024).toPandas()
    by = out.groupby([out.sequence_id // 16, "queue"]).length.sum().unstack(fill_value=0)
    end = out.groupby("queue").sequence_id.max()
    on = [s for s in sources if targets[s] > 0]
    last = min(end[s] for s in on) // 16
    assert last >= 2
    share = np.array([targets[s] / sum(targets.values()) for s in on])
    done = by.loc[: last - 1, on].cumsum()
    assert np.abs(done.to_numpy() - np.outer(done.sum(axis=1), share)).max() <= 2 * 16 * 1024 / 8
    late = [s for s in sources if not targets[s]]
    assert late and out[out.queue.isin(late)].sequence_id.min() >= out[out.queue.isin(on)].sequence_id.max()


def test_fast_and_slow_ids_are_equal():
    ranks, model = path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(model)
    t.encode_special_tokens = True
    r, parts = random.Random(4), [*"  \n\t'abcthe入é\0ñ😀<s>0x19.,  ", "<|endoftext|>", "'ll", "the"]
    for x in [" " * 300_000, "a" * 30_000, *("".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(2000))]:
        assert token_ids(x, ranks, model).tolist() == t.encode(x, add_special_tokens=False).ids


def test_packed_ids_equal_the_library_by_default(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    r, parts = random.Random(5), ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "the", " a", "'ll", "é", "\0", "19"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", " " * 20_000 + "<|endoftext|>" + " " * 20_000, *("".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(300))]
    got = defaultdict(list)
    for p in pack(spark.createDataFrame([(i, x, f"s{i % 3}") for i, x in enumerate(texts)], "doc_id long, text string, source string"), with_ids=True).collect():
        got[p.doc_id].append((p.start, p.ids, p.doc_tokens))
    for i, x in enumerate(texts):
        want = [*t.encode(x, add_special_tokens=False).ids, 0]
        assert [k for _, ids, _ in sorted(got[i]) for k in ids] == want and {n for _, _, n in got[i]} == {len(want)}, repr(x)
    assert [k for k in sorted(got[0])[0][1]] == [64, 220, 50256, 275, 0]


# 4


def test_line_dedup_equals_counting(spark, odd, docs, empty):
    for df in (odd.where("doc_id IS NOT NULL"), docs):
        data = pairs(df)
        holders = defaultdict(set)
        for d, x in data:
            for k in line_keys(x.encode(), 20)[1]:
                holders[k].add(d)
        want = []
        for d, x in data:
            lines, keys = line_keys(x.encode(), 20)
            left = [y for y, k in zip(lines, keys, strict=True) if k is None or len(holders[k]) < 3 or max(holders[k]) == d]
            want.append((d, len(lines), len(lines) - len(left), hashlib.sha256(b"\n".join(left)).hexdigest()))
        assert rows(dedup_lines(df), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)
    assert dedup_lines(odd).count() == odd.count() and dedup_lines(empty).count() == 0
    cut = without_repeats(odd)
    assert cut.columns == odd.columns and {r.text for r in cut.where("doc_id IN (8, 9)").collect()} == {"own 8", "own 9"}


# 5


def test_language_of_held_out_documents_and_pages(spark, odd, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    model = language_id.train(d.where("doc_id % 4 <> 0"))
    held = d.where("doc_id % 4 = 0 AND length(text) >= 200").select("lang", "text").collect()
    right = [model.langs[int(model.likelihood(r.text).argmax())] == r.lang for r in held]
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = language_id.identify(pages, model).collect()
    assert len(out) == pages.count() and sum(r.lang == r.declared for r in out) >= 0.97 * len(out)
    some = spark.createDataFrame([(None, None, None), (1, "http://a.example.de/", None), (1, "http://a.example.de/", None), (2, ":::", "<html lang=de>"), (3, "https://[bad", "x")], "page_id long, url string, html string")
    got = language_id.identify(some.selectExpr("*", "1 AS like", "2 AS host"), model).collect()
    assert len(got) == 5 and all(0 < r.p_lang <= 1 for r in got) and next(r for r in got if r.page_id == 2).lang == "de"
    assert language_id.identify(some.where("false"), model).count() == 0
    assert language_id.identify(some, language_id.train(empty)).count() == 5


def test_language_model_counts_whole_texts(spark):
    long = [(1, "aaa " * 2000 + "zzz " * 2000, "x"), (2, "bbb " * 2000 + "yyy " * 2000, "w")]
    model = language_id.train(spark.createDataFrame(long, "doc_id long, text string, lang string"))
    assert [model.langs[int(model.likelihood(t).argmax())] for t in ("zzz zzz", "yyy yyy")] == ["x", "w"]


def test_rare_languages_are_known(spark):
    many = spark.range(20_000).selectExpr("id AS doc_id", "'the cat of the house' AS text", "'en' AS lang")
    rare = spark.createDataFrame([(i, f"{w} " * 20, w) for i, w in enumerate(("qqx", "wwy", "kkz"), 20_000)], "doc_id long, text string, lang string")
    model = language_id.train(many.unionByName(rare))
    assert model.langs == ["en", "kkz", "qqx", "wwy"]
    assert [model.langs[int(model.likelihood(t).argmax())] for t in ("qqx qqx", "the house")] == ["qqx", "en"]
    got = language_id.identify(spark.createDataFrame([(1, "http://a.example/", "<html lang=wwy>")], "page_id long, url string, html string"), model).first()
    assert got.lang == "wwy"
    assert len(language_id.train(many.where("doc_id < 300").withColumn("lang", F.col("doc_id").cast("string"))).langs) == 300


def test_pages_are_read_as_by_patterns_but_in_linear_time():
    import html
    import re
    import time

    dropped = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>")
    lang = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})")
    meta = re.compile(r"(?is)<meta\b[^>]*?http-equiv\s*=\s*[\"']?content-language[\"']?[^>]*?content\s*=\s*[\"']?([a-z]{2,3})")
    r, parts = random.Random(8), ["<!--", "-->", "<script", "</script >", "<STYLE>", "</style>", "<", ">", "a", " ", "&amp;", "<html", "<meta", " lang=de", " lang = 'fr", "http-equiv=content-language", " content=es", "\n", "<p>", "xlang=it"]
    for _ in range(5000):
        x = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert language_id.visible(x) == html.unescape(re.sub(r"(?s)<[^>]*>", " ", dropped.sub(" ", x))), x
        found = lang.search(x) or meta.search(x)
        assert language_id.declared(x) == (found[1].lower() if found else None), x
    start = time.perf_counter()
    for x in ("<!--", "<html ", "<script ", "<", "<meta http-equiv=content-language ", "<html lang", "</script ", "&"):
        language_id.visible(x * 300_000)
        language_id.declared(x * 300_000)
    assert time.perf_counter() - start < 60


def test_posteriors_equal_bayes_rule(spark):
    """Every page's posterior from sums in plain Python; a hot host, lone hosts, hosts of one domain, pages without anything."""
    r = random.Random(6)
    docs = [(i, " ".join(r.choice(w) for _ in range(30)), k) for i, (k, w) in enumerate([("de", ["der", "und", "nicht"]), ("en", ["the", "and", "not"]), ("fr", ["le", "et", "pas"])] * 4)]
    model = language_id.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    words = [w for _, t, _ in docs for w in t.split()]
    rows_ = []
    for i in range(120):
        host = r.choice(["big.example.com"] * 4 + [f"h{i}.example.com", f"x{i % 9}.de", ""])
        path = r.choice(["", "fr/", "de-at/x", "zz/y", "a/b"])
        html = r.choice(["", "<html lang=fr>", "<html lang='xx'>", "<html lang=EN>"]) + " ".join(r.choice(words) for _ in range(r.choice([0, 1, 4, 20])))
        rows_.append((i, f"http://{host}/{path}" if host else None, html or None))
    n, langs, trust, strength = len(model.langs), model.langs, 0.9, 5.0

    def soft(v):
        e = np.exp(np.array(v) - max(v))
        return e / e.sum()

    def said(x):
        return [np.log(trust) if k == x else np.log((1 - trust) / (n - 1)) for k in langs] if x in langs else [0.0] * n

    seen = []
    for _, url, html in rows_:
        host, domain, suffix, path = language_id.address(url or "")
        like, d = model.likelihood(language_id.visible(html or "")), language_id.declared(html or "")
        seen.append((host, domain, suffix, path, d, like, soft(like + np.array(said(d)))))
    total = sum(x[6] for x in seen)
    want = {}
    for (i, _, _), x in zip(rows_, seen, strict=True):
        of = [sum(y[6] for y in seen if y[k] == x[k]) - x[6] for k in range(3)]
        prior = (total + 1) / (total + 1).sum()
        at_domain = (of[1] + strength * prior) / (of[1].sum() + strength)
        at_host = (of[0] + strength * at_domain) / (of[0].sum() + strength)
        score = x[5] + np.array(said(x[4])) + np.log((of[2] + 1) / (total - x[6] + 2)) + np.log(at_host)
        if x[3] in langs:
            score = score + np.log((sum(y[6] for y in seen if y[3] == x[3]) + 0.5) / (total + 0.5 * (n + 1)))
        p = soft(score)
        want[i] = (langs[int(p.argmax())], round(float(p.max()), 6))
    got = language_id.identify(spark.createDataFrame(rows_, "page_id long, url string, html string"), model).collect()
    assert {g.page_id: (g.lang, round(g.p_lang, 6)) for g in got} == want


# 6


def slow_features(x):
    import re

    space = "\x20\x09-\x0d"
    words = re.findall(f"[^{space}]+", x)
    three = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = set()
    for i in range(len(words) - 2):
        if three[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = x.split("\n")
    dup = sum(bool(re.search(f"[^{space}]", y)) and y in lines[:i] for i, y in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(hit)


def test_quality_features_and_votes(spark, odd, docs, empty):
    for df in (docs, odd):
        out = quality_rules.judge(df)
        want = sorted(((d, *f, f[0] < 50 or 100 * f[4] > 50 * f[0]) for d, x in pairs(df) for f in [slow_features(x)]), key=repr)
        assert rows(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
        assert out.where("base_failed AND kept").count() == 0
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_posteriors_tell_good_from_bad(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    out = quality_rules.judge(d).join(d.select("doc_id", "quality"), "doc_id").where("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.99 and n[0, False] > 2 * n[0, True]


def test_estimation_recovers_accuracies():
    r = np.random.default_rng(1)
    good = r.random(20000) < 0.8
    acc = np.array([0.95, 0.9, 0.8, 0.85, 0.9])
    right = r.random((20000, 5)) < acc
    votes = np.where(right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None]) * (r.random((20000, 5)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    odds, weights = quality_rules.estimate(patterns, counts.astype(float))
    score = odds + np.take_along_axis(weights[None].repeat(20000, 0), votes[:, :, None] + 1, 2)[:, :, 0].sum(axis=1)
    assert ((score > 0) == good).mean() > 0.96 and abs(1 / (1 + np.exp(-odds)) - 0.8) < 0.05


def slow_votes(x):
    import re

    n, chars, symbols, dup, repeat = slow_features(x)
    words = [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", x)]
    lines = sum(bool(re.search("[^\x20\x09-\x0d]", y)) for y in x.split("\n"))
    stops, kinds, digits, longest = len(set(words) & quality_rules.STOP_WORDS), len(set(words)), len(re.findall("[0-9]", x)), max(map(len, words), default=0)
    w, c = max(n, 1), max(chars, 1)
    say = lambda good, bad: 1 if good else -1 if bad else 0
    return (
        say(n >= 80, n < 50),
        say(3 <= c / w <= 9, c / w < 2.5 or c / w > 12),
        say(symbols / w <= 0.05, symbols / w >= 0.2),
        say(dup == 0 and lines >= 2, dup / max(lines, 1) > 0.5),
        say(repeat / w <= 0.1, repeat / w > 0.3),
        say(stops >= 3, stops == 0 and n >= 20),
        say(kinds >= 0.2 * w, kinds < 0.1 * w and n < 2000),
        say(digits <= 0.05 * c, digits > 0.25 * c),
        say(longest <= 60, longest > 400),
    )


def test_verdicts_equal_a_plain_estimation(spark, odd, docs):
    """Expectation-maximisation text by text, without patterns or matrices."""
    import math

    for df in (docs, odd):
        data = pairs(df)
        votes = [slow_votes(x) for _, x in data]
        rules_ = range(9)
        good = [0.2 if -1 in v else 0.95 for v in votes]
        last = None
        for _ in range(300):
            odds = math.log((sum(good) + 90) / (sum(1 - g for g in good) + 10))
            weight = {}
            for r in rules_:
                on_good, on_bad = {-1: 1.0, 0: 15.0, 1: 84.0}, {-1: 30.0, 0: 20.0, 1: 50.0}
                for v, g in zip(votes, good, strict=True):
                    on_good[v[r]] += g
                    on_bad[v[r]] += 1 - g
                for k in (-1, 0, 1):
                    weight[r, k] = math.log(on_good[k] / sum(on_good.values())) - math.log(on_bad[k] / sum(on_bad.values()))
            score = [odds + sum(weight[r, v[r]] for r in rules_) for v in votes]
            good = [1 / (1 + math.exp(-min(max(s, -500), 500))) for s in score]
            if last and max(abs(weight[k] - last[k]) for k in weight) < 1e-9:
                break
            last = weight
        want = Counter((d, round(g, 6), g >= 0.5 and not (f[0] < 50 or 100 * f[4] > 50 * f[0])) for (d, x), g in zip(data, good, strict=True) for f in [slow_features(x)])
        assert Counter((r.doc_id, round(r.p_good, 6), r.kept) for r in quality_rules.judge(df).collect()) == want


# 7


def test_co_training_on_held_out_labels(spark, odd, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    features = quality_classifier.featured(d)
    model = quality_classifier.train(features, labels.where("doc_id % 3 <> 0"))
    out = quality_classifier.score(features, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert len(out) > 80 and sum(r.kept == (r.quality == 1) for r in out) / len(out) > 0.93
    got = quality_classifier.score(quality_classifier.featured(odd), model)
    assert got.count() == odd.count() and got.where("p_quality IS NULL OR isnan(p_quality)").count() == 0
    assert quality_classifier.score(quality_classifier.featured(empty), model).count() == 0
    assert {r.p_quality for r in quality_classifier.classify(odd, labels.where("false")).collect()} == {0.5}


def test_co_training_equals_a_plain_loop(spark):
    """Rounds over all unlabelled documents, in memory; repeated ids, contradicting and odd labels among them."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)
    d = d.unionByName(d.where("doc_id % 50 = 0"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    labels = labels.unionByName(labels.where("doc_id % 40 = 0").selectExpr("doc_id", "1 - quality AS quality")).unionByName(labels.where("false").unionByName(spark.createDataFrame([(1, 7), (None, 1), (2, None)], "doc_id long, quality int")))
    features = quality_classifier.featured(d)
    most, sure, limit = 15, 0.9, 200
    rows_ = features.collect()
    said = defaultdict(set)
    for r in labels.collect():
        if r.quality in (0, 1):
            said[r.doc_id].add(r.quality)
    first = {}
    for r in rows_:
        first[r.doc_id] = min(r.key, first.get(r.doc_id, r.key))
    order = {r.doc_id: r.h for r in features.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).distinct().collect()}
    sample = sorted((i for i in first if i is not None and len(said[i]) == 1), key=lambda i: (order[i], i))[:limit]
    by_key = {r.key: r for r in rows_}
    known = sorted((by_key[first[i]] for i in sample), key=lambda r: (quality_classifier.xxhash.xxh3_64_intdigest(str(r.key)), r.key))
    y = np.array([min(said[r.doc_id]) for r in known], float)
    own = {v: np.array([r[v] for r in known]) for v in "tm"}
    pool = [r for r in rows_ if r.doc_id not in set(sample)]
    place = np.arange(len(y)) % 8
    learned = {"t": [], "m": []}

    def fit(v):
        x = np.array([*own[v][(place != 3) & (place != 7)], *(r[v] for r, _ in learned[v])])
        return quality_classifier.Logistic().fit(x, np.array([*y[(place != 3) & (place != 7)], *(k for _, k in learned[v])]))

    for _ in range(4):
        now = {v: fit(v) for v in "tm"}
        fresh = {}
        for v, w in (("t", "m"), ("m", "t")):
            have = {r.key for r, _ in learned[v]}
            p = [(1 / (1 + np.exp(-np.clip(now[w].score(np.array([r[w]]))[0], -30, 30))), r) for r in pool if r.key not in have]
            bad = sorted(((x, r.key, r) for x, r in p if x <= 1 - sure), key=lambda z: z[:2])[:most]
            good = sorted(((-x, r.key, r) for x, r in p if x >= sure), key=lambda z: z[:2])[:most]
            fresh[v] = [(r, 0) for *_, r in bad] + [(r, 1) for *_, r in good]
        for v in "tm":
            learned[v] += fresh[v]
    assert min(map(len, learned.values())) > most
    text, meta = (fit(v).calibrate(own[v][place == 3], y[place == 3]) for v in "tm")
    both = quality_classifier.Logistic(1.0).fit(np.column_stack([text.log_odds(own["t"][place == 7]), meta.log_odds(own["m"][place == 7])]), y[place == 7])
    want = {r.key: 1 / (1 + np.exp(-both.score(np.column_stack([text.log_odds(np.array([r["t"]])), meta.log_odds(np.array([r["m"]]))]))[0])) for r in rows_}
    model = quality_classifier.train(features, labels, rows=limit, most=most, sure=sure)
    got = Counter((r.doc_id, round(r.p_quality, 5)) for r in quality_classifier.score(features, model).collect())
    assert got == Counter((r.doc_id, round(float(want[r.key]), 5)) for r in rows_)


# 8


def linked(data, threshold=0.8):
    sets = {d: set(shingles(x.encode()).tolist()) for d, x in data}
    links = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    root = {d: d for d in sets}
    blank = [d for d in sets if not sets[d]]
    changed = True
    while changed:
        changed = False
        for a, b in [*links, *zip(blank, blank[1:], strict=False)]:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    n = Counter(x for p in links for x in p)
    return sorted(((d, root[d], n[d] if sets[d] else len(blank) - 1) for d in sets), key=repr)


def near_copies(n):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    base = [r.choice(words) for _ in range(220)]
    out = [(i, " ".join(r.choice(words) if r.random() < 0.012 else w for w in base)) for i in range(n)]
    out += [(n + i, " ".join(base[:40] + [r.choice(words) for _ in range(150)])) for i in range(n)]
    return [*out, (3 * n, " ".join(base)), (3 * n + 1, " ".join(base)), (3 * n + 2, ""), (3 * n + 3, None), (3 * n + 4, "a b"), (3 * n + 5, "A  b")]


@pytest.mark.parametrize("leaf,block,exact", [(64, 2048, 512), (4, 8, 8)])
def test_join_finds_all_links(spark, docs, monkeypatch, leaf, block, exact):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "EXACT_BLOCK", exact)
    df = spark.createDataFrame(near_copies(40), "doc_id long, text string")
    assert rows(jaccard_classes(df), "doc_id", "class_id", "n_links") == linked(pairs(df))
    if leaf == 64:
        assert rows(jaccard_classes(docs), "doc_id", "class_id", "n_links") == linked(pairs(docs))


def test_join_of_odd_rows(spark, odd, empty):
    out = {r.doc_id: r for r in jaccard_classes(odd).collect()}
    assert jaccard_classes(odd).count() == odd.count() and out[2].class_id == 1 and out[2].n_links == 2 and out[3].class_id == out[5].class_id == 3 and out[None].class_id is None
    one = keep_one(odd)
    assert one.columns == odd.columns and sorted(r.doc_id or 0 for r in one.collect()) == [0, 1, 3, 6, 7, 8, 9, 10, 11]
    assert jaccard_classes(empty).count() == 0


# 9


def test_licences(spark, odd, empty):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n http://www.apache.org/licenses/LICENSE-2.0\n"
    assert license_scan.matches(["bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "mit-short", "bsd-grant"]) == ["BSD-3-Clause", "MIT"]
    assert license_scan.matches(["bsd-source", "bsd-grant"]) == [] and license_scan.matches(["mit-grant", "isc-grant", "mit-notice"]) == ["X11-like", "0BSD-like"]
    assert [k for _, k in license_scan.sentence_ids("Text.\nReleased under the  MIT License.\nMore. Licensed under CC BY-NC 4.0.")] == ["mit-short", "cc-by-nc-4"]
    assert [k for _, k in license_scan.sentence_ids(apache)] == ["apache-2-the", "apache-2-use", "apache-2-copy"]
    assert licences("Copyright 2020 X. All rights reserved.") == ["Proprietary"] and licences("Copyright 2020 X. All rights reserved.\n" + NOTICES["BSD-2-Clause"]) == ["BSD-2-Clause"]
    assert licences("# SPDX-License-Identifier: GPL-2.0-or-later\n") == ["GPL-2.0-or-later"] and licences("SPDX-License-Identifier: MIT") == ["MIT"]
    out = {r.doc_id: r for r in license_scan.scan_licenses(odd).collect()}
    assert out[11].licenses == ["Apache-2.0"] and out[3].licenses == [] and license_scan.scan_licenses(odd).count() == odd.count()
    assert license_scan.scan_licenses(empty).count() == 0


NOTICES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
NOTICES |= {
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:""",
    "EPL-2.0": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "EPL-1.0": """This program and the accompanying materials
are made available under the terms of the Eclipse Public License v1.0
which accompanies this distribution, and is available at
http://www.eclipse.org/legal/epl-v10.html""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.""",
    "GPL-2.0-only": """GNU GENERAL PUBLIC LICENSE
Version 2, June 1991""",
    "LGPL-2.1-only": """GNU LESSER GENERAL PUBLIC LICENSE
Version 2.1, February 1999""",
    "LGPL-3.0-only": """GNU LESSER GENERAL PUBLIC LICENSE
Version 3, 29 June 2007""",
    "AGPL-3.0-only": """GNU AFFERO GENERAL PUBLIC LICENSE
Version 3, 19 November 2007""",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
}
NOTICES["LGPL-3.0-or-later"] = NOTICES["GPL-3.0-or-later"].replace("GNU General", "GNU Lesser General").replace("GNU\nGeneral", "GNU\nLesser General")
NOTICES["LGPL-3.0-or-later"] = NOTICES["LGPL-3.0-or-later"].replace("the\nGNU General", "the\nGNU Lesser General")
NOTICES["AGPL-3.0-or-later"] = NOTICES["LGPL-3.0-or-later"].replace("Lesser", "Affero")
NOTICES["BSD-4-Clause"] = NOTICES["BSD-3-Clause"].replace("3. Neither", "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   This product includes software developed by X.\n\n4. Neither")
NOTICES["GPL-2.0-or-later"] = NOTICES["GPL-3.0-or-later"].replace("software:", "software;").replace("version 3", "version 2")
NOTICES["BSD-2-Clause"] = NOTICES["BSD-3-Clause"].split("\n\n3.")[0]
NOTICES["BSD-1-Clause"] = NOTICES["BSD-3-Clause"].split("\n\n2.")[0]
NOTICES["X11-like"], NOTICES["0BSD-like"] = NOTICES["MIT"].split("\n\n")[0], NOTICES["ISC"].split("\n\n")[0]
SHORT = {
    "MIT": ["Released under the MIT License", "Licensed under the MIT license"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License\nVersion 2.0, January 2004"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License version 3", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works"],
    "CC0-1.0": ["Licensed under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "Proprietary": ["All rights reserved"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
}
SHORT |= {f"CC-{k}-4.0": [f"Licensed under CC {k} 4.0"] for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA")} | {"CC-BY-NC-ND-4.0": []}
for k, x in {"BY": "", "BY-SA": "-ShareAlike", "BY-NC": "-NonCommercial", "BY-ND": "-NoDerivatives", "BY-NC-SA": "-NonCommercial-ShareAlike", "BY-NC-ND": "-NonCommercial-NoDerivatives"}.items():
    SHORT[f"CC-{k}-4.0"].append(f"This work is licensed under a Creative Commons Attribution{x} 4.0 International License")
for k in license_scan.SPDX:
    SHORT.setdefault(k, []).append(f"SPDX-License-Identifier: {k}")


def licences(text):
    return license_scan.matches([k for _, k in license_scan.sentence_ids(text)])


def test_rules_on_their_notices():
    assert {*NOTICES, *SHORT} == {name for name, _ in license_scan.RULES}
    for name, text in [*NOTICES.items(), *((k, f"{x}.") for k, xs in SHORT.items() for x in xs)]:
        for form in (text, f"A program.\n\n{text}\n\nMore text.", "/*\n" + "".join(f" * {x}\n" for x in text.split("\n")) + " */", text.replace("\n", "\r\n")):
            assert licences(form) == [name], form


def test_every_rule_and_sentence_can_fire():
    for name, rule in license_scan.RULES:
        text = "\n".join(f"{license_scan.SENTENCES[k]}." for k in rule)
        assert [k for _, k in license_scan.sentence_ids(text)] == list(rule) and name in licences(text)
    taken = {k for _, rule in license_scan.RULES for k in rule}
    assert {*license_scan.SENTENCES} == taken


def test_notices_directly_after_or_before_other_lines():
    for name, text in NOTICES.items():
        assert licences(f"Copyright (c) 2020 X\n{text}") == [name]
        assert licences(f"Copyright (c) 2020 X\nA program\n{text.removesuffix('.')}\nmore text") == [name]


@pytest.mark.parametrize("gap", ["\n", "  ", "\u00a0", "\t", "-", "\r\n"])
def test_sentences_alone_with_any_gap_between_words(gap):
    for k, x in license_scan.SENTENCES.items():
        assert [i for _, i in license_scan.sentence_ids(f"Some text.\n{x.replace(' ', gap)}.")] == [k]


# 10


def test_decontamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "the CAT, of the house and the dog is in it"), (1, "own"), (2, None), (3, "..."), (10, "qui n'a pas"), (None, "zzz"), (4, "own")], "item_id long, text string")
    out = {(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in report(odd, bench).collect()}
    every = "1,4"
    assert (8, 1, 2, True) in out and (3, 0, 0, False) in out and (4, 0, 0, False) in out and (None, 4, 1, True) in out and any(d == 1 and n == 132 for d, n, _, _ in out)
    assert {r.items_sha256 for r in report(odd, bench).where("doc_id = 9").collect()} == {hashlib.sha256(every.encode()).hexdigest()}
    left = decontaminate(odd, bench)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 7, 11]
    cut = {r.doc_id: r.text for r in decontaminate(odd, bench, remove="spans").collect()}
    assert cut[8] == "one line that is shared by three documents here\n8" and cut[3] is None and len(cut[6]) > 1000
    assert report(empty, bench).count() == 0 and report(odd, bench.where("false")).where("contaminated").count() == 0


# all


@pytest.fixture(scope="module")
def long_texts(spark):
    """Texts of some megabytes: many words, one word, many lines, many blanks; the first twice."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(5000)]
    many = " ".join(r.choice(words) for _ in range(200_000))
    texts = [many, many, "x" * 100_000, "line of some twenty characters and more\n" * 10_000, "\n" * 200_000, " " * 200_000, "ab " * 50_000]
    return spark.createDataFrame([(i, x, f"s{i % 2}", "en", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, source string, lang string, n_chars long").repartition(4)


def test_very_long_texts(spark, long_texts):
    d = long_texts
    n = {r.doc_id: r for r in d.select("doc_id", F.octet_length("text").alias("b")).collect()}
    assert {(r.doc_id, r.n_bytes) for r in count_tokens(d).collect()} == {(i, x.b) for i, x in n.items()}
    cut = {r.doc_id: r for r in remove_repeats(d).collect()}
    assert all(cut[i].n_removed == n[i].b for i in range(7)) and cut[0].n_spans == 1
    assert sum(r.length for r in pack(d).collect()) == sum(r.doc_tokens for r in pack(d).dropDuplicates(["doc_id"]).collect())
    assert {r.doc_id: r.n_lines for r in dedup_lines(d).collect()}[4] == 200_001
    q = {r.doc_id: r for r in quality_rules.judge(d).collect()}
    assert q[0].n_words == 200_000 and q[2].longest == 100_000 and q[3].n_dup_lines == 9_999 and q[6].base_failed
    assert quality_classifier.classify(d, spark.createDataFrame([], "doc_id long, quality int")).count() == 7
    j = {r.doc_id: r for r in jaccard_classes(d).collect()}
    assert j[1].class_id == 0 and j[5].class_id == j[4].class_id == 4 and j[6].n_links == 0
    assert license_scan.scan_licenses(d).where("n_known > 0").count() == 0
    bench = spark.createDataFrame([(1, "ab " * 12), (2, "line of some twenty characters and more line of some")], "item_id long, text string")
    hit = {r.doc_id: r for r in report(d, bench).collect()}
    assert hit[6].n_hit == 50_000 and hit[3].n_hit == 69_996 and not hit[0].contaminated and hit[2].n_words == 1
    pages = d.select(F.col("doc_id").alias("page_id"), F.lit("http://x.de/").alias("url"), F.concat(F.lit("<html lang=de>"), F.repeat(F.lit("<!--"), 100_000), "text").alias("html"))
    assert language_id.identify(pages, language_id.train(d)).count() == 7
