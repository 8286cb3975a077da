"""Package metadata, declaration files, tarballs, caches and versions of tables."""

import io
import json
import tarfile

from pyspark.sql import functions as F

from spoorline import functions as X
from spoorline.functions.metadata import method_evidence
from spoorline.operators import enrichment, model
from spoorline.sources import artefacts, files, sinks

TYPES = """/** Opens it. */
export declare function open(path: string, cb?: (e: Error) => void): number;
// not this
declare function open(path: URL): number;
export interface Box {
  /** Shuts it.
   * Really. */
  close(hard?: boolean): { ok: boolean; why: string };
  reopen(): void;
  size?: () => number
}
/* open(x): hidden; */
"""


def test_evidence():
    assert method_evidence(TYPES, "open") == "/** Opens it. */\nexport declare function open(path: string, cb?: (e: Error) => void): number;\n\n// not this\ndeclare function open(path: URL): number;"
    assert method_evidence(TYPES, "close") == "/** Shuts it.\n   * Really. */\nclose(hard?: boolean): { ok: boolean; why: string };"
    assert method_evidence(TYPES, "size") == "size?: () => number" and method_evidence(TYPES, "hidden") is None and method_evidence(None, "x") is None and method_evidence("x", None) is None
    many = "\n".join(f"declare function f(a{k}: {'x' * 600}): void;" for k in range(20))
    assert method_evidence(many, "f").endswith("/* ...truncated... */") and method_evidence(many, "f").count("declare") <= 12


def test_evidence_of_files(spark):
    rows = [([("a.d.ts", "declare function g(): 1;"), ("b.d.ts", TYPES)], ["b.d.ts"], "open"), ([("a.d.ts", "declare function open(): 1;"), ("b.d.ts", TYPES)], ["b.d.ts"], "open"), ([("a.d.ts", "declare function open(): 1;")], None, "open"), (None, None, "open"), ([("a.d.ts", "x")], [], None)]
    df = spark.createDataFrame(rows, "f array<struct<path:string,text:string>>, first array<string>, m string")
    got = [r.e for r in df.select(X.declared_evidence("f", "first", "m").alias("e")).collect()]
    assert got[0].startswith("/** Opens") and got[1].startswith("/** Opens") and got[2] == "declare function open(): 1;" and got[3:] == [None, None]


def test_markdown(spark):
    text = "# Title #\n\n\n\nSome **bold** and *soft* `code`, [link](http://x) ![pic](y).\n\n- one\n2. two\n\n> said\n\n```js\nlet a_b_c = 1;\n```\n<b>x</b>"
    assert spark.createDataFrame([(text,), (None,)], "t string").select(X.plain_text("t").alias("p")).first().p == "Title\n\nSome bold and soft code, link pic.\n\none\ntwo\n\nsaid\n\nlet a_b_c = 1;\nx"


def test_tarballs(spark):
    def packed(**texts):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for name, text in texts.items():
                info = tarfile.TarInfo("package/" + name.replace("__", "."))
                info.size = len(text)
                t.addfile(info, io.BytesIO(text.encode()))
        return out.getvalue()

    good = packed(README__md="read me", package__json=json.dumps({"types": "./z.d.ts", "exports": {".": [{"types": "y.d.ts"}]}}), a__d__ts="a", z__d__ts="z", index__js="x")
    rows = spark.createDataFrame([("p", bytearray(good)), ("q", bytearray(b"no")), ("r", None)], "path string, content binary")
    got = {r.path: r for r in enrichment.tarballs(rows).collect()}
    assert got["p"].readme == "read me" and [d.path for d in got["p"].declarations] == ["z.d.ts", "a.d.ts"] and got["p"].entry_types == ["z.d.ts", "y.d.ts"]
    assert got["q"].readme is None and got["r"].declarations is None


def test_versions_of_a_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for k in range(4):
        assert sinks.overwrite(spark.range(k + 1), path).count() == k + 1
        assert sinks.current(spark, path).count() == k + 1
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 2
    (tmp_path / "t" / "_current").unlink()
    assert sinks.current(spark, path).count() == 4


def test_options_and_reports(spark, tmp_path):
    assert sinks.CacheOptions.of(spark, "/x") == sinks.CacheOptions("/x", True)
    r = spark.createDataFrame([("p", True, None)], "package_name string, bad boolean, x string")
    assert json.loads(sinks.report_rows(r).first().report) == {"package_name": "p", "bad": True}
    p = spark.createDataFrame([(1,)], "a int")
    sinks.write_programs(p, p, p, str(tmp_path / "g"))
    assert spark.read.parquet(f"{tmp_path}/g/edges").count() == 1


def test_fields_and_files(spark):
    df = spark.createDataFrame([('{"a": 1, "devDependencies": {"x": "1"}}',), ("[1]",), (None,)], "t string")
    assert [r.t for r in df.select(artefacts.without_fields("t", "devDependencies", "scripts").alias("t")).collect()] == ['{"a":1}', "[1]", None]
    f = spark.createDataFrame([("a.js", "x"), ("node_modules/b.js", "bad"), ("c/node_modules/d.js", None)], "path string, text string")
    assert [r.path for r in files.without_modules(f).collect()] == ["a.js"]

    def tool(x):
        if x == "bad":
            raise ValueError(x)
        return x.upper()

    assert [r.text for r in files.rewritten(f, tool).collect()] == ["X", "bad", None]


def test_instructions(tmp_path):
    (tmp_path / "route.md").write_text("Go.")
    (tmp_path / "static_verify_header.md").write_text("Head")
    (tmp_path / "static_verify_body.md").write_text("Body")
    texts = model.instructions(str(tmp_path))
    assert texts["route"] == "Go." and texts["static_verify"] == "Head\n\nBody" and texts["locate"] == model.INSTRUCTIONS["locate"]
    assert model.asked("route", "{}", "before", texts) == "Go.\n\n## Prior Analysis Context\nbefore\n\n{}" and model.asked("route", "{}", "", texts) == "Go.\n\n{}"


def test_trust_and_releases(spark):
    t = lambda *v: spark.range(1).select(X.trust_rule(*[F.lit(x) for x in v]).alias("t")).first().t
    assert t(20000, True, 3, "", True, None) == "trusted" and t(None, None, None, None, None, 10001) == "trusted" and t(5, False, 3, "r", True, 1) == "untrusted" and t(5, True, 1, "", True, 1) == "untrusted" and t(5, True, 1, "r", False, 1) == "ask"
