"""Slices of a small file, by hand, and lines against a plain version."""

import random

from pyspark.sql import functions as F

from spoorline.operators.rendering import NODE, render, rendered

CODE = """const é = 1;
function f(a) {
  let x = 1;
  if (a) {
    run(x);
  }

  send(a, run(x));
}
go();   
"""


def node(part, info=(), hit=True, scope=False, nth=0):
    b, p = CODE.encode(), part.encode()
    at = -1
    for _ in range(nth + 1):
        at = b.index(p, at + 1)
    head = b.index(b"{", at) + 1 if scope else None
    return {"start": at, "end": at + len(p), "head": head, "foot": at + len(p) - 1 if scope else None, "hit": hit and not scope, "info": list(info)}


FUNCTION = CODE[CODE.index("function") : CODE.index("go()") - 1]


def test_scopes_containers_and_leaves():
    scope = node(FUNCTION, scope=True, hit=False)
    got = render(CODE, [scope, node("run(x)", ["exec"]), node("send(a, run(x));", ["net", "net"]), node("run(x)", ["inner"], nth=1), node("go();", [])])
    assert got == "function f(a) {\n    run(x) // exec\n  send(a, run(x) // inner); // net\n}\ngo();"
    assert render(CODE, [scope]) == "" and render(CODE, []) == "" and render("", [scope]) == ""
    crossing = {**node("send(a"), "end": len(CODE.encode())}
    assert render(CODE, [scope, crossing, node("go();")]) == "go();"
    assert render(CODE, [{**scope, "head": None, "foot": None, "hit": True, "info": None}]).startswith("function f(a) {\n  let x = 1;")
    assert render(CODE, [node(FUNCTION, ["same"], hit=False), scope, node("run(x)")]).endswith("} // same")


def test_lines_of_random_texts():
    r = random.Random(5)
    for _ in range(200):
        lines = ["".join(r.choice("ab é") for _ in range(r.randrange(1, 9))) + "." for _ in range(r.randrange(1, 12))]
        text, nodes, want, at = "\n".join(lines), [], [], 0
        for x in lines:
            if r.random() < 0.4:
                nodes.append({"start": at, "end": at + len(x.encode()), "head": None, "foot": None, "hit": True, "info": ["i"]})
                want.append(x + " // i")
            at += len(x.encode()) + 1
        r.shuffle(nodes)
        assert render(text, nodes) == "\n".join(want)


def test_rows(spark):
    deep = [{"start": i, "end": 6000 - i, "head": None, "foot": None, "hit": True, "info": []} for i in range(3000)]
    assert render("x" * 6000, deep) == "x" * 6000
    rows = [(1, CODE, [node("go();", ["z"]), None]), (1, CODE, [node("go();", ["z"]), None]), (2, None, []), (3, CODE, None), (4, "", []), (5, CODE, [])]
    df = spark.createDataFrame(rows, f"k int, source string, nodes array<{NODE}>")
    got = [(r.k, r.out) for r in df.select("k", rendered(F.col("source"), F.col("nodes")).alias("out")).collect()]
    assert got == [(1, "go(); // z"), (1, "go(); // z"), (2, None), (3, None), (4, ""), (5, "")]
    assert df.where("false").select(rendered(F.col("source"), F.col("nodes"))).count() == 0
