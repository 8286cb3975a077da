"""Slices of code: lines worth showing, annotations, and what is known of third-party calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import eval_preview, one_line, security_hits


def hit_lines(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, line, last): the numbers, from 0, of lines that name something sensitive, and of the text's last line."""
    lines = df.select(*by, F.split(text, "\n", -1).alias("__ls"))
    return lines.select(*by, (F.size("__ls") - 1).alias("last"), F.posexplode("__ls").alias("line", "__l")).where(security_hits(F.col("__l"))).select(*by, "line", "last")


def annotation(node: Column, name: Column, behavior: Column, third_party: Column, unresolved: Column) -> Column:
    """The comment on a node's last line; the first template that fits."""
    mark = F.concat(F.lit(" [Node ID: "), node.cast("string"), F.lit("]"))
    shown = F.coalesce(one_line(name), F.lit("<unknown>"))
    return (
        F.when(third_party, F.concat(F.lit("third-party call "), shown, mark))
        .when(unresolved, F.concat(F.lit("unresolved call "), shown, mark))
        .when(behavior.isNotNull(), F.concat(shown, F.lit(": "), behavior, mark))
        .otherwise(F.concat(F.lit("call "), shown, mark))
    )


def with_call_info(code: Column, info: Column) -> Column:
    """code with its infos, an array, as a comment; none if there is none."""
    return F.when(F.size(info) > 0, F.concat(code, F.lit(" // "), F.array_join(info, ", "))).otherwise(code)


def collapsed(code: Column) -> Column:
    """No space at line ends, and no more than one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(code, r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n")


def merged_statements(rows: DataFrame, by: list[str], pos: str, infos: list[str]) -> DataFrame:
    """One row for each `by`: arrays of infos joined in order of pos, each value once."""
    ordered = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(pos, c))), lambda x: x[c])))
    return rows.groupBy(*by).agg(*[ordered(c).alias(c) for c in infos])


def enrichment(nodes: DataFrame, trusted: str, module: str, api: str) -> DataFrame:
    """nodes with `level`: trusted, api, module or none, by what metadata says."""
    level = F.when(F.coalesce(trusted, F.lit(False)), "trusted").when(F.coalesce(api, F.lit(False)), "api").when(F.coalesce(module, F.lit(False)), "module").otherwise("none")
    return nodes.withColumn("level", level)


def positional(args: DataFrame, params: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Arguments with the parameter at their place; parameters without one have null."""
    return params.join(args, [*by, pos], "left")


def bound_parameters(args: DataFrame, params: DataFrame, by: list[str]) -> DataFrame:
    """Parameters (by, pos, name, rest) with `values`, the arguments (by, pos, value) they take, each in order of pos, then value: `this` takes none
    and is passed over, a rest parameter takes all that is left, and nothing comes after it."""
    w = Window.partitionBy(*by).orderBy("pos")
    p = params.where("name <> 'this'").withColumn("k", F.row_number().over(w)).withColumn("__cut", F.min(F.when(F.col("rest"), F.col("k"))).over(Window.partitionBy(*by)))
    p = p.where("__cut IS NULL OR k <= __cut")
    a = args.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("pos", "value"))).select(*by, "k", "value")
    last = p.where("rest").select(*by, F.col("k").alias("__cut"))
    a = a.join(last, by, "left").withColumn("k2", F.least("k", F.coalesce("__cut", "k")))
    got = a.groupBy(*by, F.col("k2").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("values"))
    return p.join(got, [*by, "k"], "left").select(*by, "pos", "name", "rest", "values")


# What annotations say are fixed formats, which judges' instructions name.

#: Columns of nodes that annotations are made from; those that a table lacks are null.
NODE = {
    "node": "bigint", "name": "string", "code": "string", "file": "string", "call_type": "string", "sensitive": "boolean", "qualified_name": "string", "call_name": "string", "domain": "string", "module": "string", "property": "string",
    "module_behavior": "string", "behavior": "string", "resolved_args": "string", "resolved_result": "string", "resolved": "boolean", "evals": "bigint", "eval_args": "array<string>", "io": "string", "pending": "string", "require": "string",
}
UNKNOWN = "<unknown>"


def _filled(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({c: F.lit(None).cast(t) for c, t in NODE.items() if c not in nodes.columns})


def _said(*parts: Column | str) -> Column:
    """A text with the node's number behind it."""
    texts = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat(*texts, F.lit(" [Node ID: "), F.col("node").cast("string"), F.lit("]"))


def _sensitive(name: Column, qualified: Column, resolved: Column) -> Column:
    """A sensitive call, with its arguments and result where they are known and of a domain whose arguments say something."""
    shown = F.col("domain").isin("Process", "File", "Network") & F.coalesce(resolved, F.lit(False))
    args, result = (F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("N/A")) for c in ("resolved_args", "resolved_result"))
    full = _said("Method name: ", name, " is a sensitive API call of ", qualified, ". Resolved arguments: ", args, ". Resolved return value: ", result, ".")
    return F.when(shown, full).otherwise(_said("Method name: ", name, " is a sensitive API call of ", qualified, "."))


def _evaluated(name: Column, qualified: Column) -> Column:
    """A call that runs text, with the texts that a run gave it; null where none did."""
    times = F.coalesce(F.nullif(F.col("evals"), F.lit(0)), F.size("eval_args").cast("long"))
    return F.when(F.col("evals").isNotNull() | F.col("eval_args").isNotNull(), _said("Method name: ", name, " is a sensitive API call of ", qualified, ". Dynamically captured ", times, " invocation(s); resolved eval source argument(s): ", eval_preview(F.coalesce("eval_args", F.array().cast("array<string>"))), "."))


def _property(name: Column, qualified: Column) -> Column:
    return _said("Method name: ", name, " is a sensitive property access of ", qualified, ".")


def static_annotation(nodes: DataFrame, out: str = "annotation") -> DataFrame:
    """nodes (of NODE) with what is said of each before a run: third-party calls, with what is known of them, before sensitive
    ones, before unresolved ones; null for others. Calls of local functions are said by callee_lines()."""
    n = _filled(nodes)
    c = F.col
    target = F.concat("module", F.lit("."), "property")
    both = F.coalesce("module_behavior", F.lit("")) != "", F.coalesce("behavior", F.lit("")) != ""
    third = (
        F.when(both[0] & both[1], _said("Method name: ", c("call_name"), ", third-party call of ", target, ". Module: ", c("module_behavior"), ". API behavior: ", c("behavior"), "."))
        .when(both[0], _said("Method name: ", c("call_name"), ", third-party call of ", target, ". Module: ", c("module_behavior"), ". API behavior: not documented."))
        .when(both[1], _said("Method name: ", c("call_name"), ", third-party call of ", target, ". API behavior: ", c("behavior"), "."))
        .otherwise(_said("Method name: ", c("call_name"), ", is a third-party API call of ", target, " with module name: ", c("module"), "."))
    )
    known = c("qualified_name").isNotNull()
    name, qualified = F.coalesce(F.when(known, c("call_name")), c("name"), F.lit(UNKNOWN)), F.coalesce("qualified_name", F.lit(UNKNOWN))
    kind = c("call_type")
    sensitive = F.when(kind == "CONDITIONAL_CALL", _said("Method name: ", name, " is a conditional sensitive API call of ", qualified, ".")).when(kind.isin("FIELD_ACCESS", "INDEX_ACCESS"), _property(name, qualified)).otherwise(_said("Method name: ", name, " is a sensitive API call of ", qualified, "."))
    unresolved = F.when(F.coalesce("call_name", F.lit("")) != "", _said("Method name: ", c("call_name"), " is statically unresolved call.")).otherwise(_said("Code: ", one_line(F.coalesce("code", F.lit(""))), " contains statically unresolved call."))
    said = F.when(kind == "FUNCTION_CALL", F.lit(None)).when(kind == "THIRD_PARTY_CALL", third).when(F.coalesce("sensitive", F.lit(False)), sensitive).when(kind == "UNRESOLVED_CALL", unresolved)
    return n.withColumn(out, said)


def dynamic_annotation(nodes: DataFrame, out: str = "annotation") -> DataFrame:
    """nodes (of NODE) with what is said of each after a run. pending tells what was left open before it: conditional, third_party or
    unresolved. The first that holds: what was conditional, with its arguments, the texts it ran, or that it didn't run;
    required modules; third-party calls and unresolved ones, with the behaviour that was seen or that none was; sensitive
    ones. Null for others."""
    n = _filled(nodes)
    c = F.col
    known = F.coalesce("sensitive", F.lit(False)) & c("qualified_name").isNotNull()
    own = F.coalesce(F.nullif(F.nullif("call_name", F.lit("None")), F.lit("")), F.lit(UNKNOWN))
    qualified = F.when(known, c("qualified_name")).otherwise(UNKNOWN)
    conditional = F.when(known & F.coalesce("resolved", F.lit(False)), _sensitive(own, qualified, c("resolved"))).otherwise(
        F.coalesce(F.when(known, _evaluated(own, qualified)), _said("Method name: ", own, " is a conditional sensitive API call of ", qualified, ". This node was NOT executed during dynamic analysis."))
    )
    seen = F.coalesce("behavior", F.lit("")) != ""
    io = F.when(F.coalesce("io", F.lit("")) != "", F.concat(F.lit(" ["), "io", F.lit("]"))).otherwise("")
    third = F.when(seen, _said("Method name: ", own, ", third-party call resolved with behavior: [", c("behavior"), "]", io)).otherwise(_said("Method name: ", own, ", third-party API call of ", F.coalesce("module", F.lit(UNKNOWN)), ".", F.coalesce("property", F.lit(UNKNOWN)), ". No API trace captured in dynamic analysis."))
    open_ = F.when(seen, _said("Method name: ", own, ", previously unresolved call resolved with behavior: [", c("behavior"), "]", io)).otherwise(_said("Method name: ", own, ", statically unresolved call. No API trace captured in dynamic analysis."))
    kind = c("call_type")
    new = (
        F.when(seen, _said("Method name: ", F.coalesce(F.when(known, c("call_name")), c("name"), F.lit(UNKNOWN)), ", sensitive API call with resolved call-chain behavior: [", c("behavior"), "]", io))
        .when(~known, F.lit(None))
        .when((kind == "CONDITIONAL_CALL") & ~F.coalesce("resolved", F.lit(False)), F.coalesce(_evaluated(c("call_name"), c("qualified_name")), _said("Method name: ", c("call_name"), " is a conditional sensitive API call of ", c("qualified_name"), ".")))
        .when(kind.isin("FIELD_ACCESS", "INDEX_ACCESS"), _property(c("call_name"), c("qualified_name")))
        .otherwise(_sensitive(c("call_name"), c("qualified_name"), c("resolved")))
    )
    said = (
        F.when(c("pending") == "conditional", conditional)
        .when(kind == "REQUIRE_CALL", _said("require() call importing module: ", F.coalesce("require", F.lit(UNKNOWN)), "."))
        .when(c("pending") == "third_party", third)
        .when(c("pending") == "unresolved", open_)
        .when(F.coalesce("sensitive", F.lit(False)), new)
    )
    return n.withColumn(out, said)


def callee_lines(calls: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, callees): a line for each local function (by, node, pos, name, file, callee, callee_file) that a node's call enters."""
    line = F.concat("name", F.lit("() in "), "file", F.lit(" -> function "), "callee", F.lit(" in "), "callee_file")
    return calls.groupBy(*by, "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]).alias("callees"))


def statements(nodes: DataFrame, by: list[str], dynamic: bool = False) -> DataFrame:
    """(by, file, statement, infos, callees): the statements that a component's nodes (by, pos, type, file, statement, annotation,
    callees) stand in, each once with all that is said of its nodes. Parameters have none of their own before a run."""
    n = nodes if dynamic else nodes.where("type IS NULL OR type <> 'METHOD_PARAMETER_IN'")
    infos = F.when(F.col("annotation").isNotNull(), F.array("annotation")).otherwise(F.array().cast("array<string>"))
    n = n.where("file IS NOT NULL AND statement IS NOT NULL").withColumn("infos", infos).withColumn("callees", F.coalesce("callees", F.array().cast("array<string>")))
    return merged_statements(n, [*by, "file", "statement"], "pos", ["infos", "callees"])


def file_slices(pieces: DataFrame, by: list[str]) -> DataFrame:
    """(by, file, code_snippet, callee_info): a file's slice (by, file, slice, callees) as lines, and its distinct callee lines."""
    return pieces.select(*by, "file", F.split("slice", "\n", -1).alias("code_snippet"), F.array_distinct("callees").alias("callee_info"))


def component_structs(slices: DataFrame, order: DataFrame, by: list[str]) -> DataFrame:
    """(by, component, code_slice, cfg_order, predecessors, successors): components with a slice of any file, as judges are given
    them; order (by, component, cfg_order, predecessors, successors), 0 and none where it says nothing."""
    body = F.struct("file", "code_snippet", "callee_info")
    s = slices.groupBy(*by, "component").agg(F.array_sort(F.collect_list(body)).alias("sliced_code"))
    j = s.join(order, [*by, "component"], "left")
    none = F.array().cast("array<bigint>")
    return j.select(*by, "component", F.to_json(F.struct("sliced_code")).alias("code_slice"), F.coalesce("cfg_order", F.lit(0)).alias("cfg_order"), F.coalesce("predecessors", none).alias("predecessors"), F.coalesce("successors", none).alias("successors"))
