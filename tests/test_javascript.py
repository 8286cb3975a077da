"""JavaScript text: tokens, spans and evals."""

from spoorline.functions.javascript import eval_calls, inlined, nodes, syntax, tokens

CODE = """const fs = require("fs"); /* eval("x") */ // f()
fs.readFile(a.b[c](1)(2), function (e, d) { new Buffer(d).toString("x"); return eval("q"); });
const g = (a) => { h(a); }; if (x) { y(); } var r = /a(b)/g.test(s); `t ${u(1)} ${`v(`}`; (function(){ k(); })();
"""


def test_tokens():
    got = [(t.kind, t.text) for t in tokens("a = b / c / 2; r = /[/]x/g.test(`q${'}'}`) // z")]
    assert ("regex", "/[/]x/g") in got and ("template", "`q${'}'}`") in got and got.count(("punct", "/")) == 2 and got[-1] == ("punct", ")")
    assert list(tokens("")) == [] and [t.text for t in tokens("`open ${x")] == ["`open ${x"]


def test_spans():
    found = {(t, CODE[s:e]) for t, _, s, e in nodes(CODE)}
    for type_, text in (("call_expression", 'require("fs")'), ("call_expression", "a.b[c](1)(2)"), ("call_expression", "a.b[c](1)"), ("member_expression", "fs.readFile"), ("subscript_expression", "a.b[c]"), ("new_expression", "new Buffer(d)"),
                        ("call_expression", 'new Buffer(d).toString("x")'), ("arrow_function", "(a) => { h(a); }"), ("function", "function(){ k(); }"), ("call_expression", "(function(){ k(); })()"), ("call_expression", "y()")):
        assert (type_, text) in found, text
    assert not any(text in ('eval("x")', "f()", "if (x)", "h(a) }") for _, text in found)
    assert nodes("f(g(") == [] and nodes("") == []


def test_lines_and_columns(spark):
    got = spark.createDataFrame([(CODE,), (None,)], "c string").select(syntax("c").alias("n")).collect()
    call = next(n for n in got[0].n if n.name == "fs.readFile" and n.type == "call_expression")
    assert (call.sl, call.sc, call.el, call.ec) == (1, 0, 1, CODE.split("\n")[1].rindex(")") + 1) and got[1].n == []


def test_isolated_evals():
    assert [(t, alone) for _, _, t, alone in eval_calls('eval("a"); x = eval("b"); f(eval("c")); eval("d") + 1; return eval("e"); eval("f")(); o.eval("g"); eval(""); eval("\\n"); eval(h)')] == [("a", True), ("b", False), ("c", True), ("d", False), ("e", False), ("f", False)]
    assert inlined("f()") == "f()" and inlined('if (a) eval("b" + "c")') == "if (a) eval_wrap_1()\n\nfunction eval_wrap_1() {\nbc;\n}\n"
