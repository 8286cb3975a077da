"""Programs from a parser's nodes: what interpreter.py reads, made from syntax trees, and what a run adds to their nodes.

A tree is rows of nodes (by, id, label, name, code, ord, arg, full_name, method_full_name, line, col) and edges (by, src, dst, label), as
sources.graphs reads them. `by` is a package or one of its entries; its trees are one group of one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import end_position, normal_path
from .joins import first_match

OUT = "fn string, seq long, node long, op string, dst string, args array<string>"
#: Operators of the parser by what they do: fixed names.
_JOINS = {"<operator>.addition": "add", "<operator>.plus": "add", "<operator>.formatString": "format", "<operator>.formattedValue": "format"}
_QUOTED = ("'", '"', "`")


class Tree:
    """One group's trees. Expressions become names: what has no name of its own is held by `#id` of its node."""

    def __init__(self, nodes: dict[int, dict], kids: dict[int, list[int]], given: dict[int, list[int]], entry: str | None = None):
        self.nodes, self.kids, self.given, self.entry = nodes, kids, given, entry
        self.rows: list[tuple] = []
        self.fns: dict[int, str] = {}
        self.by_name: dict[str, int] = {}

    def run(self) -> list[tuple]:
        inside = {k for ks in self.kids.values() for k in ks}
        methods = [i for i, n in self.nodes.items() if n["label"] == "METHOD"]
        self.by_name = {self.nodes[i]["full_name"]: i for i in methods if self.nodes[i]["full_name"]}
        tops = [i for i in methods if i not in inside]
        for k, i in enumerate(sorted(tops)):
            name = (self.nodes[i]["full_name"] or "").removesuffix("::program")
            self.name_functions(i, "" if len(tops) == 1 or name == self.entry else name or f"file{k}")
        for i in sorted(self.fns):
            self.seq, self.fn = 0, self.fns[i]
            for c in self.declared(i):
                self.emit(c, "assign", self.nodes[c]["name"], [f"fn:{self.fns[c]}"])
            for c in self.parts(i):
                self.statement(c)
        return self.rows

    def name_functions(self, top: int, name: str) -> None:
        """Functions get the names of those around them before their own."""
        todo = [(top, name)]
        while todo:
            i, fn = todo.pop()
            if self.nodes[i]["label"] == "METHOD":
                self.fns[i] = fn
            for c in self.kids.get(i, ()):
                n = self.nodes[c]
                own = fn if n["label"] != "METHOD" else f"{fn}:{(n['name'] or '<lambda>').replace(':', '_')}" if fn else (n["name"] or "<lambda>").replace(":", "_")
                todo.append((c, own))

    def declared(self, i: int) -> list[int]:
        """Functions with a name that stand right in another: their names hold them from its start."""
        out, todo = [], list(self.kids.get(i, ()))
        while todo:
            c = todo.pop()
            n = self.nodes[c]
            if n["label"] != "METHOD":
                todo += self.kids.get(c, ())
            elif n["name"] and not n["name"].startswith(("<", ":")):
                out.append(c)
        return sorted(out)

    def parts(self, i: int) -> list[int]:
        def place(c: int):
            o = self.nodes[c]["ord"]
            return (0, o, c) if o is not None and o >= 0 else (1, 0, c)

        return sorted(self.kids.get(i, ()), key=place)

    def emit(self, node: int, op: str, dst: str | None, args: list[str | None]) -> str | None:
        self.rows.append((self.fn, self.seq, node, op, dst, args))
        self.seq += 1
        return dst

    def statement(self, i: int) -> None:
        n = self.nodes[i]
        if n["label"] == "METHOD_PARAMETER_IN":
            if (n["name"] or n["code"]) != "this":
                self.emit(i, "param", n["name"] or n["code"], ["rest"] if (n["code"] or "").startswith("...") else [])
        elif n["label"] == "RETURN":
            parts = self.parts(i)
            self.emit(i, "return", None, [self.value(parts[0]) if parts else None])
        elif n["label"] in ("BLOCK", "CONTROL_STRUCTURE", "TYPE_DECL"):
            for c in self.parts(i):
                self.statement(c)
        elif n["label"] == "IDENTIFIER":
            self.emit(i, "identifier", None, [n["name"] or n["code"]])
        elif n["label"] == "CALL":
            self.value(i)

    def arguments(self, i: int) -> list[int]:
        got = [c for c in self.given.get(i, ()) if self.nodes[c]["arg"] is not None and self.nodes[c]["arg"] >= 1]
        return sorted(got, key=lambda c: self.nodes[c]["arg"])

    def value(self, i: int) -> str | None:
        """The operand that holds a node's value; statements that work it out come before."""
        n = self.nodes[i]
        label, code = n["label"], n["code"] or ""
        if label == "LITERAL":
            if code[:1] in _QUOTED:
                return "'" + code[1:-1] + "'"
            return code if code.replace(".", "", 1).lstrip("-").isdigit() else f"'{code}'"
        if label in ("IDENTIFIER", "FIELD_IDENTIFIER"):
            return n["name"] or code
        if label in ("METHOD_REF", "METHOD"):
            target = i if label == "METHOD" else self.by_name.get((n["method_full_name"] or "").strip())
            return f"fn:{self.fns[target]}" if target in self.fns else None
        if label == "BLOCK":
            out = None
            for c in self.parts(i):
                out = self.value(c)
            return out
        if label == "CALL":
            return self.call(i, n["name"] or "")
        for c in self.parts(i):
            self.value(c)
        return None

    def path(self, i: int) -> str | None:
        """A name or a path of literal keys that can be set."""
        n = self.nodes[i]
        args = self.arguments(i)
        if n["label"] == "CALL" and n["name"] in ("<operator>.fieldAccess", "<operator>.indexAccess") and len(args) == 2:
            base = self.path(args[0])
            key = self.value(args[1])
            if n["name"] == "<operator>.indexAccess":
                key = key[1:-1] if key and key[0] in _QUOTED else None
            return f"{base}.{key}" if base and key and "." not in key else base
        return n["name"] or n["code"] if n["label"] == "IDENTIFIER" else None

    def call(self, i: int, name: str) -> str | None:
        args, dst = self.arguments(i), f"#{i}"
        if name == "<operator>.assignment" and len(args) == 2:
            value = self.value(args[1])
            to = self.path(args[0])
            self.emit(i, "assign", to, [value])
            return to
        if name == "<operator>.assignmentPlus" and len(args) == 2:
            to = self.path(args[0])
            self.emit(i, "assign_plus", to, [self.value(args[1])])
            return to
        if name in ("<operator>.fieldAccess", "<operator>.indexAccess") and len(args) == 2:
            base, key = self.value(args[0]), self.value(args[1])
            return self.emit(i, "field" if name.endswith("fieldAccess") else "index", dst, [base, key])
        if name == "<operator>.new":
            callee = next((c for c in self.parts(i) if c not in args), args[0] if args else None)
            rest = [a for a in args if a != callee]
            return self.emit(i, "new", dst, [self.value(callee) if callee is not None else None, *(self.value(a) for a in rest)])
        if name in _JOINS:
            return self.emit(i, _JOINS[name], dst, [self.value(a) for a in args])
        if name == "<operator>.await":
            return self.emit(i, "await", dst, [self.value(a) for a in args[:1]])
        if name in ("<operator>.iterator", "<operator>.in", "<operator>.of"):
            for a in args:
                self.value(a)
            return self.emit(i, "iterate", dst, [])
        if name in ("<operator>.arrayInitializer", "<operator>.objectLiteral", "__ecma.Array.factory"):
            for a in args:
                self.value(a)
            return self.emit(i, "object", dst, [])
        if name.startswith("<operator>."):
            return self.emit(i, "add", dst, [*(self.value(a) for a in args), None])
        if name == "require":
            return self.emit(i, "require", dst, [self.value(a) for a in args[:1]])
        callee = next((c for c in self.parts(i) if c not in args and (self.nodes[c]["arg"] is None or self.nodes[c]["arg"] < 1) and self.nodes[c]["label"] != "FIELD_IDENTIFIER"), None)
        held = self.value(callee) if callee is not None else name or None
        return self.emit(i, "call", dst, [held, *(self.value(a) for a in args)])


def statements_of(nodes: DataFrame, edges: DataFrame, by: list[str], entry: str | None = None) -> DataFrame:
    """(by, fn, seq, node, op, dst, args): the statements of a tree's functions, for interpreter.interpreted(). What a call takes is
    worked out before it, from left to right. Of several files' trees the one of the file in the column `entry` (one of by) is
    the top level, the others are modules. Nodes without a label, and edges to nodes that aren't there, are passed over."""
    columns = ["id", "label", "name", "code", "ord", "arg", "full_name", "method_full_name"]
    n = nodes.where("label IS NOT NULL").select(*by, F.struct(*columns).alias("n"), F.lit(None).cast("struct<src:bigint,dst:bigint,label:string>").alias("e"))
    e = edges.where("label IN ('AST', 'ARGUMENT')").select(*by, F.lit(None).cast(n.schema["n"].dataType).alias("n"), F.struct(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "label").alias("e"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        def plain(d: dict) -> dict:
            return {k: None if v is None or v != v else int(v) if k in ("id", "ord", "arg") else v for k, v in d.items()}

        def rows(values) -> list[dict]:
            return [v if isinstance(v, dict) else v.asDict() for v in values if v is not None and not isinstance(v, float)]

        table = {d["id"]: d for d in map(plain, rows(group["n"]))}
        kids: dict[int, list[int]] = {}
        given: dict[int, list[int]] = {}
        for d in rows(group["e"]):
            if d["src"] in table and d["dst"] in table:
                to = (kids if d["label"] == "AST" else given).setdefault(d["src"], [])
                if d["dst"] not in to:
                    to.append(d["dst"])
        start = group[entry].iloc[0] if entry and len(group) else None
        out = pd.DataFrame(Tree(table, kids, given, start).run(), columns=["fn", "seq", "node", "op", "dst", "args"])
        for k, c in enumerate(by):
            out.insert(k, c, group[c].iloc[0] if len(group) else None)
        return out

    keys = T.StructType([nodes.schema[c] for c in by])
    return n.unionByName(e).groupBy(*by).applyInPandas(one, T.StructType(keys.fields + T._parse_datatype_string(OUT).fields))


def node_span(line: Column, col: Column, code: Column) -> Column:
    """struct(sl, sc, el, ec) of a node by its place (line from 1) and text, as events name their callers: lines from 0."""
    end = end_position(line - 1, col, F.regexp_replace(code, r"^\s+|\s+$", ""))
    return F.struct((line - 1).cast("int").alias("sl"), col.cast("int").alias("sc"), end["line"].cast("int").alias("el"), end["col"].cast("int").alias("ec"))


def with_events(nodes: DataFrame, events: DataFrame, by: list[str], kind: str = "function") -> DataFrame:
    """nodes (by, node, file, line, col, code) with `idx`, the first event (by, idx, type, file, sl, sc, el, ec) that a run made at their
    place: calls and constructions by function, member accesses by property; null where it made none."""
    span = node_span(F.col("line"), F.col("col"), F.col("code"))
    n = nodes.withColumn("__s", span).withColumn("__f", normal_path(F.col("file"))).select(*by, "node", F.col("__f").alias("file"), "__s.*")
    e = events.where(F.col("type") == kind).withColumn("file", normal_path(F.col("file")))
    return nodes.join(first_match(n, e, [*by, "file", "sl", "sc", "el", "ec"], "idx").select(*by, "node", "idx"), [*by, "node"], "left")


def literal_arguments(arguments: DataFrame, by: list[str]) -> DataFrame:
    """(by, call, texts): a call's arguments (by, call, pos, label, code) in order: literals without their quotes, null for what isn't
    one; functions aren't listed."""
    text = F.when(F.col("label") == "LITERAL", F.regexp_replace(F.trim("code"), "^[\"']+|[\"']+$", ""))
    rows = arguments.where("label IS NULL OR label <> 'METHOD_REF'").groupBy(*by, "call").agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))).alias("a"))
    return rows.select(*by, "call", F.transform("a", lambda x: x["t"]).alias("texts"))


def lambda_argument(arguments: DataFrame, programs: DataFrame, by: list[str]) -> DataFrame:
    """(by, call, pdg): the function that is a call's last argument (by, call, pos, type_full_name, method_full_name), if it is a lambda, by its
    full name among the programs (by, pdg, full_name)."""
    last = arguments.groupBy(*by, "call").agg(F.max_by(F.struct("type_full_name", "method_full_name"), "pos").alias("l"))
    named = last.where(F.contains("l.type_full_name", F.lit("<lambda>"))).select(*by, "call", F.trim("l.method_full_name").alias("n"))
    return named.join(programs.groupBy(*by, F.trim("full_name").alias("n")).agg(F.min("pdg").alias("pdg")), [*by, "n"]).select(*by, "call", "pdg")


def qualified_path(name: Column) -> Column:
    """struct(root, path): what a catalog's dotted name stands for: a global, Buffer or a core module, and the properties from there."""
    parts = F.split(name, r"\.")
    is_global = F.get(parts, F.lit(0)) == "global"
    return F.when(name.isNotNull(), F.struct(F.when(is_global, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))).alias("root"), F.when(is_global, F.array().cast("array<string>")).otherwise(F.slice(parts, 2, 1 << 20)).alias("path")))


def return_arcs(entered: DataFrame, returns: DataFrame, by: list[str]) -> DataFrame:
    """(by, src, dst, label): data arcs from what functions return (by, pdg, id) to the calls that enter them (by, node, pdg)."""
    return entered.join(returns, [*by, "pdg"]).select(*by, F.col("id").alias("src"), F.col("node").alias("dst"), F.lit("DDG").alias("label")).distinct()
