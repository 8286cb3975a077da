"""The whole run against a plain version, and programs of several files."""

from collections import defaultdict

from spoorline.operators import interpreter, programs
from spoorline.plans import PLANS
from spoorline.plans.views import arcs

SF = "/root/testdata/sf0.001"


def test_package_run(spark):
    graphs = defaultdict(list)
    for r in arcs(spark, SF).collect():
        graphs[r.g].append((r.src, r.dst, r.label))
    want = set()
    for g, rows in graphs.items():
        data = [(a, b) for a, b, x in rows if x != "CFG"]
        seeds = {a for a, _, _ in rows if a % 3 == 1}

        def reach(start, arcs_):
            seen, todo = set(start), list(start)
            while todo:
                v = todo.pop()
                for a, b in arcs_:
                    if a == v and b not in seen:
                        seen.add(b)
                        todo.append(b)
            return seen

        inside = reach(seeds, data) | reach(seeds, [(b, a) for a, b in data])
        both = [(a, b) for a, b in data if a in inside and b in inside]
        both += [(b, a) for a, b in both]
        left, verdicts = set(inside), []
        while left:
            part = reach({min(left)}, both)
            left -= part
            said = {f"v{v % 10}." for v in part if v % 3 == 1}
            verdicts.append("malicious" if "v7." in said else "undetermined" if "v3." in said else "benign")
        n = len(verdicts)
        one = "malicious" if "malicious" in verdicts else "undetermined" if "undetermined" in verdicts else "benign"
        want.add((g, one, "none" if not n else "single" if n == 1 else "rule", n))
    assert {tuple(r) for r in PLANS["q_package_run"](spark, SF).collect()} == want and len(want) > 20


def tree(spark, *files):
    """files: (name, [(id, label, name, code, ord, arg, parent, given?)]) -> nodes, edges of one program."""
    nodes, edges = [], []
    for rows in files:
        for i, label, name, code, ord_, arg, parent, extra in rows:
            nodes.append((1, "main.js", i, label, name, code, ord_, arg, extra.get("full"), extra.get("ref")))
            if parent:
                edges.append((1, "main.js", parent, i, "AST"))
                if arg is not None:
                    edges.append((1, "main.js", parent, i, "ARGUMENT"))
    n = spark.createDataFrame(nodes, "g int, entry string, id long, label string, name string, code string, ord int, arg int, full_name string, method_full_name string")
    return n, spark.createDataFrame(edges, "g int, entry string, src long, dst long, label string")


def call(i, name, parent, ord_, *args, arg=None, callee=None):
    """Rows of a call with literal, name or given arguments."""
    rows = [(i, "CALL", name, name, ord_, arg, parent, {})]
    if callee:
        rows += [(i + 1, "CALL", "<operator>.fieldAccess", "x", 1, 0, i, {}), (i + 2, "IDENTIFIER", callee[0], callee[0], 1, 1, i + 1, {}), (i + 3, "FIELD_IDENTIFIER", callee[1], callee[1], 2, 2, i + 1, {})]
    for k, a in enumerate(args, 1):
        label = "LITERAL" if a[0] in "'\"0123456789" else "METHOD_REF" if a.startswith("ref ") else "IDENTIFIER"
        rows.append((i + 3 + k, label, None if label == "LITERAL" else a, a, 1 + k, k, i, {"ref": a[4:]} if label == "METHOD_REF" else {}))
    return rows


def method(i, name, full, parent=None, ord_=1):
    return [(i, "METHOD", name, name, ord_, None, parent, {"full": full})]


def test_several_files_launched_scripts_and_lambdas(spark):
    main = [
        *method(1, ":program", "main.js::program"),
        *call(10, "<operator>.assignment", 1, 1, "cp", arg=None), *call(15, "require", 10, 3, "'child_process'", arg=2),
        *call(30, "<operator>.assignment", 1, 2, "lib", arg=None), *call(35, "require", 30, 3, "'./lib'", arg=2),
        *call(50, "exec", 1, 3, "'node ./job.js -x'", callee=("cp", "exec")),
        *call(60, "setTimeout", 1, 4, "ref main.js::program:<lambda>0", "5"),
        *method(70, "<lambda>0", "main.js::program:<lambda>0", 1, 5), *call(75, "exec", 70, 1, "'late'", callee=("cp", "exec")),
        *call(90, "run", 1, 6, "'x'", callee=("lib", "run")),
    ]
    lib = [*method(200, ":program", "lib.js::program"), *call(210, "<operator>.assignment", 200, 1), (214, "CALL", "<operator>.fieldAccess", "exports.run", 1, 1, 210, {}), (215, "IDENTIFIER", "exports", "exports", 1, 1, 214, {}), (216, "FIELD_IDENTIFIER", "run", "run", 2, 2, 214, {}), (217, "METHOD_REF", "run", "run", 2, 2, 210, {"ref": "lib.js::program:run"}),
           *method(220, "run", "lib.js::program:run", 200, 2), (221, "METHOD_PARAMETER_IN", "a", "a", 1, None, 220, {}), *call(230, "eval", 220, 2, "a")]
    job = [*method(300, ":program", "job.js::program"), *call(310, "fetch", 300, 1, "'http://x'")]
    out = interpreter.interpreted(programs.statements_of(*tree(spark, main, lib, job), ["g", "entry"], "entry"), ["g", "entry"]).collect()
    got = {(r.node, r.qn, r.state) for r in out}
    assert {(50, "child_process.exec", "external"), (50, "job.js", "launched"), (310, "fetch", "external"), (60, "setTimeout", "external"), (75, "child_process.exec", "external"), (35, "lib.js", "module")} <= got


def test_this_of_functions(spark):
    p = [("", 0, 1, "assign", "this.a", ["'top'"]), ("", 1, 2, "call", None, ["fn:f"]), ("f", 0, 3, "assign", "this.a", ["'own'"]), ("f", 1, 4, "call", None, ["fn:f:<lambda>0"]), ("f:<lambda>0", 0, 5, "call", None, ["eval", "this.a"]), ("", 2, 6, "call", None, ["eval", "this.a"])]
    df = spark.createDataFrame([(1, *r) for r in p], "g int, fn string, seq int, node int, op string, dst string, args array<string>")
    got = {r.node: (r.state, r.literal) for r in interpreter.interpreted(df, ["g"]).where("qn = 'eval'").collect()}
    assert got == {5: ("external", True), 6: ("external", True)}
