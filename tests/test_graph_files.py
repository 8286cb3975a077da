"""Functions' graphs from a folder of files: data and control flow, the parser's attributes, parameters."""

from spoorline.operators import syntax
from spoorline.sources import graphs, sinks


def test_functions_of_a_folder(spark, tmp_path):
    for d in ("pdg", "cfg"):
        (tmp_path / d).mkdir()
    head = 'digraph "f" {\n"1" [label="m" NAME="run" FILENAME=" a.js" LINE_NUMBER="3" LINE_NUMBER_END="9" COLUMN_NUMBER="1" COLUMN_NUMBER_END="2" FULL_NAME="a.js::program:run"]\n'
    (tmp_path / "pdg" / "7-pdg.dot").write_text(head + '"2" [label="p"]\n"3" [label="c"]\n"4" [label="r"]\n"2" -> "3" [label="DDG: p"]\n"2" -> "3" [label="CDG: "]\n"3" -> "4" [label="DDG: x"]\n}')
    (tmp_path / "cfg" / "7-cfg.dot").write_text(head + '"1" -> "2" [label=""]\n"2" -> "3" [label=""]\n"3" -> "4" [label=""]\n}')
    lam = head.replace('"run"', '"<lambda>0"').replace('"1" [', '"11" [')
    (tmp_path / "pdg" / "8-pdg.dot").write_text(lam + '"12" [label="p"]\n"13" [label="q"]\n"11" -> "12" [label="DDG: z"]\n}')
    (tmp_path / "cfg" / "8-cfg.dot").write_text(lam + '"11" -> "12" [label=""]\n}')
    (tmp_path / "pdg" / "9-pdg.dot").write_text('digraph {\n"21" [label="lonely" NAME=":program"]\n"21" -> "22" [label="DDG: z"]\n}')  # its control flow is missing
    (tmp_path / "pdg" / "10-pdg.dot").write_text("no graph at all")
    (tmp_path / "cfg" / "10-cfg.dot").write_text("")
    rows = [(1, "METHOD", "run", None, 3, 1), (2, "METHOD_PARAMETER_IN", "p", "p", 3, 5), (3, "CALL", "f", "f(\np)", 4, None), (4, "METHOD_RETURN", None, None, 9, 1), (11, "METHOD", "<lambda>0", None, 3, 1), (12, "METHOD_PARAMETER_IN", "p", "p", 3, 5), (13, "METHOD_PARAMETER_IN", "q", "q", 3, 7)]
    attributes = spark.createDataFrame(rows, "id long, label string, name string, code string, line int, col int")
    formals = spark.createDataFrame([(f"file:{tmp_path}/8", "p")], "pdg string, name string")
    programs, edges, nodes = graphs.functions(spark, str(tmp_path / "pdg"), str(tmp_path / "cfg"), attributes, formals)
    assert {(r.src, r.dst): sorted(r.labels) for r in edges.collect()} == {(1, 2): ["CFG", "DDG"], (2, 3): ["CFG", "DDG: p"], (11, 12): ["CFG", "DDG", "DDG: z"]}
    p = {r.pdg: r for r in programs.collect()}
    assert (p[1].name, p[1].file, p[1].sl, p[1].el, p[1].type, p[1].nodes) == ("run", "a.js", 3, 9, "function", 4) and p[11].type == "lambda" and p[21].type == "program" and len(p) == 3
    shown = {r.id: r.shown for r in nodes.collect()}
    assert shown[3] == "[3][4:0][CALL]: f(\\np)" and shown[2] == "[2][3:5][METHOD_PARAMETER_IN]" and 21 not in shown
    sinks.write_programs(programs, edges, nodes, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "edges")).count() == 3


def test_same_ids_in_two_files(spark, tmp_path):
    for k, label in (("a", "CFG"), ("b", "DDG: x")):
        (tmp_path / f"{k}.xml").write_text(f'<graphml><graph><node id="1"><data key="labelV">CALL</data><data key="ORDER">2</data></node><node id="2"><data key="labelV">METHOD</data></node><edge source="1" target="2"><data key="labelE">{label}</data></edge></graph></graphml>')
    nodes, edges = graphs.graphml(spark, str(tmp_path))
    assert sorted(r.labels for r in edges.collect()) == [["CFG"], ["DDG: x"]] and nodes.count() == 4
    assert {(r.id, r.ord) for r in graphs.syntax_nodes(nodes).collect()} == {(1, 2), (2, None)}


def test_trees_without_parents_or_orders(spark):
    n = spark.createDataFrame([(1, 1, "CALL", "f", None, None), (1, 2, "IDENTIFIER", "b", 2, 1), (1, 3, "IDENTIFIER", "a", -1, 0), (1, 4, "IDENTIFIER", "c", 1, 2)], "g int, id int, label string, name string, ord int, arg int")
    e = spark.createDataFrame([(1, 1, 2, "AST"), (1, 1, 3, "AST"), (1, 1, 4, "AST"), (1, 1, 2, "ARGUMENT"), (1, 1, 3, "ARGUMENT"), (1, 1, 9, "AST")], "g int, src int, dst int, label string")
    assert [(r.id, r.pos) for r in syntax.children(n, e, ["g"]).orderBy("pos").collect()] == [(4, 0), (2, 1), (3, 2)]
    assert [r.id for r in syntax.arguments(n, e, ["g"]).collect()] == [2] and [r.id for r in syntax.first_own_part(n, e, ["g"]).collect()] == [4]
    assert syntax.enclosing_method(n, e, ["g"]).count() == 0
