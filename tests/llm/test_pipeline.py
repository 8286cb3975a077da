"""The pipeline's stages on a small fixture, each held against a plain version of its decision."""

import random
import shutil

import pytest

import corpus_pipeline
from spoorline.llm.jaccard_join import shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randrange(3, 8))) for _ in range(3000)] + ["the", "of", "and"] * 300
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, line, leak = text(150), "this very line stands in many documents of the set", text(12)
    rows = [(i, text(120) + "\n" + line + "\n" + text(60)) for i in range(20)]
    rows += [(20, base + " one"), (21, base + " two"), (22, base), (23, text(20)), (24, text(100) + " " + leak + " " + text(50)), (25, None), (26, " ".join(w + "***" for w in text(150).split())), (None, text(90))]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, x, "en", f"s{k % 3}", None if x is None else len(x)) for k, (i, x) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, "short")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    yield str(d), rows, line
    shutil.rmtree(d)


def test_stages(spark, folder):
    d, rows, line = folder
    docs, cols, ids = spark.read.parquet(f"{d}/documents.parquet"), None, []
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        kept = docs.collect()
        docs = spark.createDataFrame(kept, docs.schema)
        assert docs.columns == cols
        ids.append({r.doc_id for r in kept})
        if name == "line dedup":
            assert [r.doc_id for r in kept if line in r.text] == [19] and all(r.n_chars == len(r.text) for r in kept)
    good, lined, near, clean = ids
    assert good == {*range(23), 24, None} and lined == good
    assert near == good - {21, 22} and all(len(shingles(x.encode())) for _, x in rows if x)
    assert clean == near - {24}
    packed = corpus_pipeline.packing(spark, docs, d).collect()
    assert {p.doc_id for p in packed} == clean


def test_run_and_entry(spark, folder):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"](spark, folder[0]).select("doc_id").distinct().count() == 22
    assert sorted(n.partition("_")[0] for n in __spark_entry__.queries() if n.startswith("op")) == sorted(f"op{k}" for k in range(1, 11))
