"""Operators on small inputs with answers derived by hand, and against plain sequential versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spoorline import functions as X
from spoorline.operators import attribution, graph, intervals, joins, log, model, slicing, verdict
from spoorline.operators.catalog import last_wins, lookup
from spoorline.sources import artefacts, files, graphs, sinks


def values(spark, f, *cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_paths(spark):
    assert values(spark, X.module_root, "package/node_modules/@s/p/lib/i.js", "node_modules/a/node_modules/b/i.js", "src/i.js", "node_modules", "node_modules/@s/", None) == ["node_modules/@s/p/", "node_modules/a/node_modules/b/", None, None, None, None]
    assert values(spark, X.base_package, "@s/p/sub", "lodash/debounce") == ["@s/p", "lodash"]
    assert values(spark, X.main_candidates, "lib/x", "x.cjs", "x.node") == [["lib/x.js", "lib/x/index.js"], ["x.cjs"], []]
    assert values(spark, X.safe_entry_name, "a/b:c.js") == ["a-b-c.js"]
    assert values(spark, X.root_ancestors, "node_modules/a/node_modules/b/i.js", "src/x.js") == [["node_modules/a/", "node_modules/a/node_modules/b/", "node_modules/b/"], [""]]
    assert values(spark, X.text_type, "#!/usr/bin/env node\nx", '{"a":1}', "<?xml version='1'?>", "hello") == ["javascript", "json", "xml", "plain_text"]
    assert values(spark, X.content_tier, "a" * 5000, "a" * 5001, "a\0b") == ["inline", "large_text", "binary"]
    end = spark.range(1).select(X.end_position(F.lit(3), F.lit(4), F.lit("f(\nx)")).alias("e")).first().e
    assert (end.line, end.col) == (4, 2)


def test_last_wins_and_backfill(spark):
    df = spark.createDataFrame([("p", "k1", 0), ("p", "k2", 1), ("p", "k1", 2), ("p", None, 3), ("p", None, 4)], "pkg string, k string, pos int")
    assert [(r.log_index, r.k) for r in log.last_wins(df, ["pkg"], ["k"], "pos").orderBy("log_index").collect()] == [(0, "k2"), (1, "k1"), (2, None), (3, None)]
    e = spark.createDataFrame([("p", 0, "p", "r0", False), ("p", 1, "p", "r1", False), ("p", 2, "q", "r2", False), ("p", 3, "p", "u", True), ("p", 4, "p", "v", True)], "pkg string, pos int, args string, result string, cb boolean")
    assert [r.result for r in log.backfill(e, ["pkg"], "args", "result", "pos", F.col("cb")).orderBy("pos").collect()] == ["r0", "v", "r2"]
    t = spark.createDataFrame([("p", i, x[0] == "C", x) for i, x in enumerate(["S0", "C1", "C2", "S1", "S2"])], "pkg string, pos int, call boolean, v string")
    assert [(r[2], r.source) for r in log.sources_of_calls(t, ["pkg"], "pos", F.col("call"), "v").orderBy("pos").collect()] == [("C2", "S1"), ("C2", "S2")]


def test_catalog(spark):
    c = last_wins(spark.createDataFrame([(1, "zlib", "gunzipSync", "a", "Compression", "x"), (2, "zlib", "gunzipSync", "a", "Compression", "y"), (3, "fs", "readFile", "b", "File", "z")], "line int, module string, property string, full_name string, domain string, behavior string"))
    df = spark.createDataFrame([("zlib.gunzipSync",), ("fs",), ("fs.readFile",), (None,)], "qn string")
    assert sorted((r.qn or "", r.behavior) for r in lookup(df, c, "qn").collect()) == [("", None), ("fs", None), ("fs.readFile", "z"), ("zlib.gunzipSync", "y")]


def test_joins(spark):
    c = spark.createDataFrame([(1, 10), (1, 20), (1, 5), (2, 4)], "k int, e int")
    assert sorted(tuple(r) for r in joins.smallest_end(c, ["k"], F.col("e"), F.lit(12)).collect()) == [(1, 20), (2, 4)]
    f = spark.createDataFrame([("a", 10, 12)], "file string, lo int, hi int")
    e = spark.createDataFrame([("a", n) for n in (9, 10, 12, 13)], "file string, at int")
    assert sorted(r.at for r in joins.in_range(f, e, ["file"], "lo", "hi", "at", 4).collect()) == [10, 12]
    b = spark.createDataFrame([("x", 6, 0, "B"), ("x", 2, 1, "A")], "n string, since int, seq int, obj string")
    r = spark.createDataFrame([(1, "x", 7), (2, "x", 1)], "ref int, n string, at int")
    assert sorted((x.ref, x.obj) for x in joins.scoped_asof(r, b, ["n"], "ref", "at", "since", ["seq"]).collect()) == [(1, "A"), (2, None)]


def test_intervals_against_sequential(spark):
    r = random.Random(1)
    cases, want = [], []
    for k in range(40):
        orphans = sorted(r.sample(range(60), r.randrange(1, 20)))
        anchors = [(c, r.randrange(60)) for c in range(3) for _ in range(r.randrange(3))]
        cases.append((k, orphans, anchors))
        owned, left = {}, set(orphans)
        for c in range(3):
            near = {a for o, a in anchors if o == c}
            grown = True
            while grown:
                new = {i for i in left if any(abs(i - a) <= 2 for a in near)}
                left, near, grown = left - new, near | new, bool(new)
                owned |= dict.fromkeys(new, c)
        want += [(k, i, c) for i, c in owned.items()]
    o = spark.createDataFrame([(k, i) for k, x, _ in cases for i in x], "k int, idx long")
    a = spark.createDataFrame([(k, c, i) for k, _, x in cases for c, i in x], "k int, chain_ord int, anchor long")
    assert sorted(tuple(x) for x in intervals.adjacency(o, a, ["k"], "idx", "chain_ord", "anchor", 2).collect()) == sorted(want)
    h = spark.createDataFrame([(1, 1, 11), (1, 5, 11), (2, 1, 11), (2, 7, 11)], "k int, line int, last int")
    assert sorted(tuple(x)[:3] for x in intervals.merged_ranges(h, ["k"], "line", "last").collect()) == [(1, 0, 7), (2, 0, 3), (2, 5, 9)]
    n = spark.createDataFrame([(1, 0, 9), (2, 2, 5), (3, 3, 4), (4, 2, 5)], "id int, lo int, hi int").withColumn("k", F.lit(0))
    assert {x.id: x.parent for x in intervals.parents(n, ["k"], "id", "lo", "hi").collect()} == {1: None, 2: 1, 4: 1, 3: 2}


def arcs(spark, pairs, label="DDG"):
    return spark.createDataFrame([("g", a, b, label) for a, b in pairs], "g string, src int, dst int, label string")


def vertices(spark, vs):
    return spark.createDataFrame([("g", v) for v in vs], "g string, v int")


def test_slices(spark):
    a, seeds = arcs(spark, [(1, 2), (2, 3), (0, 2), (4, 5), (6, 7)]), vertices(spark, [2, 5, 9])
    assert {r.v: r.component for r in graph.slice_components(a, seeds, ["g"]).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4}
    barred = graph.slice_components(a, seeds, ["g"], program=vertices(spark, [1]))
    assert {r.v for r in barred.collect()} == {0, 2, 3, 4, 5}
    near = graph.nearest_flagged(vertices(spark, [1]), arcs(spark, [(1, 2), (2, 3), (1, 4), (3, 5)]), vertices(spark, [1, 3, 4, 5]), ["g"])
    assert {r.v for r in near.collect()} == {3, 4}


@pytest.mark.parametrize("seed", range(3))
def test_walks_against_plain_search(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(25), r.randrange(25)) for _ in range(40)]
    out = {}
    for v in {x for p in pairs for x in p}:
        seen, todo = {v}, [v]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[v] = seen
    deps = spark.createDataFrame([("g", a, b) for a, b in pairs], "g string, parent int, child int")
    assert {(x.pkg, x.dep) for x in graph.closure(deps, ["g"]).collect()} == {(v, w) for v, s in out.items() for w in s}
    root = {v: v for v in out}
    for _ in out:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = graph.components(vertices(spark, out), arcs(spark, pairs), ["g"])
    assert {x.v: x.component for x in got.collect()} == root


def test_edge_types(spark):
    cases = [(["DDG: x", "CFG"], "CFG_DDG"), (["CDG: x"], "CFG"), (["REMOVE: x"], "REMOVE"), (["REMOVE: x", "DDG: y"], "DDG"), ([], "CFG")]
    df = spark.createDataFrame(cases, "labels array<string>, want string")
    assert df.where(graph.edge_type(F.col("labels")) != F.col("want")).count() == 0


def test_attribution_by_hand(spark):
    names = ["package/index.js", "node_modules/a/a.js", "package/cb.js", "node_modules/b/b.js", "node_modules/a/node_modules/d/d.js", "package/x.js", "node_modules/b/n.js"]
    ev = spark.createDataFrame([("p", i, n) for i, n in enumerate(names)], "pkg string, idx long, file string")
    claimed = spark.createDataFrame([("p", 0)], "pkg string, idx long")
    chains = spark.createDataFrame([("p", f"c{i}", i) for i in range(3)], "pkg string, chain string, chain_ord int")
    roots = spark.createDataFrame([("p", "c0", "node_modules/a/"), ("p", "c0", "node_modules/d/"), ("p", "c1", "node_modules/b/"), ("p", "c2", "node_modules/b/")], "pkg string, chain string, root string")
    anchors = spark.createDataFrame([("p", "c0", 1)], "pkg string, chain string, idx long")
    got = sorted((r.chain, r.idx, r.confidence) for r in attribution.attribute(ev, claimed, chains, roots, anchors, ["pkg"], 2).collect())
    assert got == [("c0", 1, "bfs"), ("c0", 2, "adjacency"), ("c0", 4, "module_root")] + [(c, i, "shared") for c in ("c1", "c2") for i in (3, 5, 6)]


def test_verdicts(spark):
    df = spark.createDataFrame([(1, "benign"), (1, "undetermined"), (2, "undetermined"), (2, "malicious"), (3, None)], "k int, j string")
    assert {r.k: r.v for r in df.groupBy("k").agg(verdict.synthesis(F.col("j")).alias("v")).collect()} == {1: "undetermined", 2: "malicious", 3: "benign"}
    rep = spark.createDataFrame([(1, "undetermined", [5, 6]), (2, "undetermined", [5, 6, 7])], "k int, judgement string, ids array<int>")
    ev = spark.createDataFrame([(1, 5, "sensitive_api"), (1, 6, "sensitive_property"), (2, 5, "sensitive_api"), (2, 6, "third_party")], "k int, id int, kind string")
    assert {r.k: (r.judgement, r.ids) for r in verdict.sanitized(rep, ev, ["k"]).collect()} == {1: ("benign", []), 2: ("undetermined", [6, 7])}


def test_judge_is_asked_once_and_repaired():
    asked = []

    def judge(x):
        asked.append(x)
        if len(asked) == 1:
            raise ConnectionError
        return "```json\n{\"a\": 1}\n```" if "It can't be used: it is no JSON" in x else "not json"

    assert model.answer_json(judge, "q", wait=0) == '{"a": 1}' and len(asked) == 3
    assert model.answer_json(lambda _: "no", "q", wait=0) is None
    assert model.answer_json(lambda _: '{"b": 1}', "q", wait=0, shape=model.launches_shape) is None
    asked.clear()

    def lost(x):
        asked.append(x)
        raise OSError("busy")

    with pytest.raises(ConnectionError):
        model.answer_json(lost, "q", wait=0)
    assert len(asked) == 5
    assert model.launches({"launches_node": True, "js_files": ["a", 1]}) == {"launches_node": True, "js_files": ["a"]}
    assert model.launches({"launches_node": "yes", "js_files": ["a"]}) == {"launches_node": False, "js_files": []}


def test_rendering(spark):
    assert values(spark, slicing.collapsed, "a  \n\n\n\nb\t", "x") == ["a\n\nb", "x"]
    df = spark.createDataFrame([(1, 2, ["b", "c"]), (1, 1, ["a", "b"])], "k int, pos int, info array<string>")
    assert slicing.merged_statements(df, ["k"], "pos", ["info"]).first().info == ["a", "b", "c"]


def test_sources(spark, tmp_path):
    (tmp_path / "cg.json").write_text(json.dumps({"files": ["a.js", "b.js"], "functions": {"0": "0:1:1:3:2", "5": "1:2:1:4:1"}, "calls": ["0:2:3:2:9"], "call2fun": [[0, 5]], "fun2fun": [[0, 5]]}))
    spans, edges = artefacts.call_graph(artefacts.texts(spark, f"{tmp_path}/cg.json"))
    assert sorted(tuple(r)[1:] for r in spans.collect()) == [("calls", 0, "a.js", 1, 2, 1, 8), ("functions", 0, "a.js", 0, 0, 2, 1), ("functions", 5, "b.js", 1, 0, 3, 0)]
    assert sorted(tuple(r)[1:] for r in edges.collect()) == [("call2fun", 0, 5), ("fun2fun", 0, 5)]
    deps = spark.createDataFrame([("x", json.dumps({"dependencies": {"a": {"dependencies": {"b": {}}}, "b": {}}})), ("y", "{bad"), ("z", None)], "path string, text string")
    assert sorted((r.parent or "", r.child) for r in artefacts.dependency_edges(deps).collect()) == [("", "a"), ("", "b"), ("a", "b")]
    m = spark.createDataFrame([("x", '{"main": "./lib/x", "scripts": {"install": "node a.js"}, "exports": {".": {"import": "./m.mjs", "require": "./c.cjs"}}, "bin": {"b": "./b.js"}}'), ("y", "{bad"), ("z", "{}")], "path string, text string")
    got = {r.path: r for r in artefacts.manifests(m).collect()}
    assert got["x"].main == ["lib/x.js", "lib/x/index.js"] and got["x"].scripts == {"install": "node a.js"} and got["x"].export_paths == ["./m.mjs", "./c.cjs"] and got["x"].bin == ["./b.js"] and not got["y"].readable and got["z"].main == ["index.js"]
    (tmp_path / "t.csv").write_text('function,fs,readFile,"[""p""]",r,/app/a.js,3,4\nshort,row\nfunction,os,hostname,,,/app/b.js,x,1\ntoo,many,a,b,c,d,1,2,3\n')
    rows = artefacts.trace(spark, f"{tmp_path}/t.csv").orderBy("pos").collect()
    assert [(r.module, r.arguments, r.line) for r in rows] == [("fs", '["p"]', 3), ("os", "", None)]
    (tmp_path / "g.dot").write_text('digraph "f" {\n"1" [label = "(METHOD,f)"]\n"2" [label = "x"]\n"1" -> "2" [label = "DDG: x"]\n"1" -> "2" [label = ""]\n"2" -> "1" [label = "DDG: "]\n}\n')
    nodes, edges = graphs.dot(spark, f"{tmp_path}/g.dot")
    assert nodes.count() == 2 and sorted((r.src, r.dst, r.label) for r in edges.collect()) == [(1, 2, "CFG"), (1, 2, "DDG: x")]
    (tmp_path / "x.xml").write_text('<graphml><graph><node id="1"><data key="labelV">CALL</data><data key="NAME">f</data></node><node id="2"><data key="labelV">METHOD</data></node><edge source="1" target="2"><data key="labelE">AST</data></edge><edge source="1" target="2"><data key="labelE">CALL</data></edge></graph></graphml>')
    nodes, edges = graphs.graphml(spark, f"{tmp_path}/x.xml")
    assert {r.id: (r.label, r.attrs) for r in nodes.collect()} == {1: ("CALL", {"NAME": "f"}), 2: ("METHOD", {})} and [r.labels for r in edges.collect()] == [["AST", "CALL"]]


def test_files_and_caches(spark, tmp_path):
    (tmp_path / "p/node_modules/a").mkdir(parents=True)
    (tmp_path / "p/a.js").write_text("x\ny")
    (tmp_path / "p/b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "p/c.dat").write_bytes(b"\x7fELF1234")
    (tmp_path / "p/node_modules/a/i.js").write_text("z")
    f = files.listing(spark, f"{tmp_path}/p")
    assert sorted(r.path for r in f.collect()) == ["a.js", "b.txt", "c.dat", "node_modules/a/i.js"]
    assert [r.path for r in files.scripts(f).collect()] == ["a.js"] and {r.path: r.lines for r in files.lines(f).collect()}["a.js"] == ["x", "y"]
    want = spark.createDataFrame([(1, i, p) for i, p in enumerate(["a.js", "a.js", "c.dat", "no.js", "../x.js", "lodash", "a.js"])], "k int, pos int, path string")
    assert [r.status for r in files.read_status(want, f, ["k"], budget=6).orderBy("pos").collect()] == ["ok", "already_visited", "binary", "not_found", "out_of_scope", "bare", "budget_exhausted"]
    cache = spark.createDataFrame([("a", "1", {"f": "x", "g": "y"}), ("b", None, None)], "pkg string, payload string, api map<string,string>")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "pkg string")
    assert {r.pkg: r.state for r in sinks.looked_up(keys, cache, "pkg", "payload").collect()} == {"a": "hit", "b": "tombstone", "c": "miss"}
    new = spark.createDataFrame([("a", None, {"f": "z"}), ("c", "3", {"h": "w"})], "pkg string, payload string, api map<string,string>")
    assert {r.pkg: (r.payload, r.api) for r in sinks.derived(cache, new, "pkg", ["api"]).collect()} == {"a": ("1", {"f": "z", "g": "y"}), "b": (None, None)}
    cache.write.parquet(f"{tmp_path}/cache")
    assert sinks.overwrite(sinks.upserted(spark.read.parquet(f"{tmp_path}/cache"), new, "pkg"), f"{tmp_path}/cache").count() == 3


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
