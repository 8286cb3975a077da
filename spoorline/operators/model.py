"""Functions that a judge (a language model in use, a rule in tests) computes, each distinct input once.

A judge is a function from text to text. What it is asked is instructions, with the history of the analysis where there is one, and
a payload as JSON. Instructions are files, read from a folder that the caller names; INSTRUCTIONS has short ones of our own.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Judge = Callable[[str], str]
Shape = Callable[[object], str | None]
_FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.S)

#: What each function asks for and the fields of its answer.
INSTRUCTIONS = {
    "static_report": "Judge the code slice. Answer JSON: judgement (benign, malicious, undetermined), key_evidence (node_id, node_type, claim), reason, node_to_be_checked.",
    "static_verify": "Check the reports against the code slice and give one. Same JSON, and files_to_read.",
    "static_reread": "Read the files and revise the report. Same JSON.",
    "dynamic_report": "Judge the slice with what was seen at run time. Answer JSON: judgement, explanation.",
    "dynamic_verify": "Check the judgement against the evidence. Answer JSON: judgement, explanation, files_to_read.",
    "dynamic_reread": "Read the files and revise the judgement. Same JSON.",
    "cross_component": "Judge all components together, in their order. Answer JSON: judgement, explanation, cross_component_evidence, node_to_be_checked.",
    "package_trust": "Say how far the package can be trusted. Answer JSON: trust_level (HIGH_TRUST, LOW_TRUST).",
    "module_functionality": "Say what the module does. Answer JSON: overall_functionality, or unknown.",
    "api_behavior": "Say what the method does. Answer JSON: api_behavior, or unknown.",
    "api_sequence": "Say what the calls do together. Answer JSON: behavior_description, key_files (file_path, operation).",
    "file_content": "Sum up the file. Answer JSON: content_summary, security_signals.",
    "static_fallback": "Judge the entry file; ask for files you need. Answer JSON: action (read_files with paths, running_synthesis; or final with judgement, reason, key_evidence).",
    "shell_command": "Judge the shell command; ask for scripts you need. Answer JSON: action (read_files with paths; or final with label, explanation, executed_js_files).",
    "route": "Choose what to do next. Answer JSON: next_action (try_enrichment, try_dynamic), reason.",
    "locate": "Name the malicious places. Answer JSON: summary, locations (file, code, reason).",
    "locate_in_files": "Name the malicious places in the files. Same JSON.",
    "node_execution": "Say whether the command launches node, and on which files. Answer JSON: launches_node, js_files.",
}


def instructions(folder: str | None = None) -> dict[str, str]:
    """INSTRUCTIONS, with those of a folder's <name>.md in place; <name>_header.md stands before <name>_body.md."""
    out = dict(INSTRUCTIONS)
    for f in sorted(Path(folder).glob("*.md")) if folder else ():
        name = f.stem
        if name.endswith("_header"):
            body = f.with_name(name.removesuffix("_header") + "_body.md")
            out[name.removesuffix("_header")] = f"{f.read_text()}\n\n{body.read_text()}" if body.exists() else f.read_text()
        elif not name.endswith("_body"):
            out[name] = f.read_text()
    return out


def asked(name: str, payload: str, history: str = "", texts: dict[str, str] | None = None) -> str:
    """What a judge is given: instructions, the history if there is one, and the payload."""
    head = (texts or INSTRUCTIONS)[name]
    return head + (f"\n\n## Prior Analysis Context\n{history}" if history else "") + f"\n\n{payload}"


def prompt(name: str, payload: Column, history: Column | None = None, texts: dict[str, str] | None = None) -> Column:
    """asked() as a column."""
    h = F.lit("") if history is None else F.coalesce(history, F.lit(""))
    return F.concat(F.lit((texts or INSTRUCTIONS)[name]), F.when(h != "", F.concat(F.lit("\n\n## Prior Analysis Context\n"), h)).otherwise(""), F.lit("\n\n"), payload)


def called(judge: Judge, text: str, attempts: int = 5, wait: float = 1.0) -> str:
    """The judge's answer. Whatever fails is tried again; the last failure is a ConnectionError."""
    for k in range(attempts):
        try:
            return judge(text)
        except Exception as e:  # whatever a remote judge raises
            if k + 1 == attempts:
                raise ConnectionError(f"no answer after {attempts} attempts") from e
            time.sleep(wait)
    raise ConnectionError("no attempt was allowed")


def parsed(answer: str | None) -> object:
    """The JSON in an answer, fenced or not; None for anything else."""
    found = _FENCED.search(answer or "")
    try:
        return json.loads(found[1] if found else answer or "")
    except ValueError:
        return None


def answered(judge: Judge, text: str, shape: Shape | None = None, repairs: int = 1, attempts: int = 5, wait: float = 1.0) -> object:
    """The answer's JSON, if it has the shape (shape() says what is wrong, or None). An answer that isn't or hasn't is sent back
    with what is wrong, `repairs` times at most; then None. A judge that can't be reached raises ConnectionError."""
    answer = called(judge, text, attempts, wait)
    for k in range(repairs + 1):
        out = parsed(answer)
        wrong = "it is no JSON" if out is None else shape(out) if shape else None
        if wrong is None:
            return out
        if k < repairs:
            answer = called(judge, f"{text}\n\nYour answer was:\n{answer}\n\nIt can't be used: {wrong}. Answer the same as one JSON object and nothing else.", attempts, wait)
    return None


def answer_json(judge: Judge, text: str, attempts: int = 5, wait: float = 1.0, shape: Shape | None = None) -> str | None:
    """answered() as JSON text with sorted keys."""
    out = answered(judge, text, shape, 1, attempts, wait)
    return None if out is None else json.dumps(out, sort_keys=True)


def judged(df: DataFrame, prompt: str, judge: Judge, answer: str = "answer", attempts: int = 5, wait: float = 1.0, shape: Shape | None = None, lost: bool = True) -> DataFrame:
    """df with the judge's answer to each prompt: distinct prompts are found by digest first, and each is asked once. With lost, a
    judge that can't be reached leaves null; without, it fails the query."""

    @F.pandas_udf(T.StringType())
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else answer_json(judge, x, attempts, wait, shape)
            except ConnectionError:
                if lost:
                    return None
                raise

        for b in batches:
            yield b.map(one)

    keyed = df.withColumn("__fp", F.sha2(F.col(prompt), 256))
    asked_ = keyed.where(F.col("__fp").isNotNull()).groupBy("__fp").agg(F.min(prompt).alias("__p")).select("__fp", ask("__p").alias(answer))
    return keyed.join(asked_, "__fp", "left").drop("__fp")


def verified(slices: DataFrame, by: list[str], slice_: str, judge: Judge, history: Column | None = None, reports: int = 3) -> DataFrame:
    """Slices with `report`: several reports on each, each asked for on its own, then one that the judge makes of those that came
    (JSON, unchecked); null where none came. Equal slices are judged once."""
    out = slices
    for k in range(reports):
        p = F.concat(prompt("static_report", F.col(slice_), history), F.lit(f"\n\nReport {k + 1} of {reports}."))
        out = judged(out.withColumn("__p", p), "__p", judge, f"__r{k}").drop("__p")
    got = F.filter(F.array(*[f"__r{k}" for k in range(reports)]), lambda r: r.isNotNull())
    p = F.when(F.size(got) > 0, prompt("static_verify", F.to_json(F.struct(F.col(slice_).alias("slice"), got.alias("reports")))))
    out = judged(out.withColumn("__p", p), "__p", judge, "report")
    return out.drop("__p", *[f"__r{k}" for k in range(reports)])


def dynamic_verdict(components: DataFrame, payload: str, judge: Judge, history: Column | None = None) -> DataFrame:
    """components with `report`: a judgement by what was seen at run time (payload, JSON), and what the judge makes of it on a second
    look; null where either fails. Equal payloads are judged once."""
    first = judged(components.withColumn("__p", prompt("dynamic_report", F.col(payload), history)), "__p", judge, "__r")
    again = F.when(F.col("__r").isNotNull(), prompt("dynamic_verify", F.to_json(F.struct(F.col(payload).alias("evidence"), F.col("__r").alias("judgement")))))
    return judged(first.withColumn("__p", again), "__p", judge, "report").drop("__p", "__r")


def cross_judged(components: DataFrame, by: list[str], judge: Judge) -> DataFrame:
    """(by, report): of entries with two components or more (by, component, cfg_order, slice, report, successors) the judgement across them, with their order;
    null where the judge fails."""
    from .verdict import synthesis_input

    payload, edges = synthesis_input(components, by)
    e = edges.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("edges"))
    j = payload.where("size(payload) > 1").join(e, by, "left")
    asked_ = j.select(*by, prompt("cross_component", F.to_json(F.struct(F.col("payload").alias("components"), F.col("edges").alias("ordering")))).alias("__p"))
    return judged(asked_, "__p", judge, "report").drop("__p")


def node_launches(commands: DataFrame, name: str, command: str, judge: Judge) -> DataFrame:
    """commands with launches_node and js_files, as launches() reads the answer; none where the judge fails or has no such field."""
    p = prompt("node_execution", F.concat(F.lit("Qualified Name: "), F.col(name), F.lit("\nCommand: "), F.col(command)))
    out = judged(commands.withColumn("__p", p), "__p", judge, "__a", shape=launches_shape)

    @F.pandas_udf("launches_node boolean, js_files array<string>")
    def read(answers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([launches(json.loads(a) if isinstance(a, str) else None) for a in answers], columns=["launches_node", "js_files"])

    return out.withColumn("__l", read("__a")).select(*commands.columns, "__l.launches_node", "__l.js_files")


def launches(answer: object) -> dict:
    """node_execution's answer as it is used: no files where node isn't launched, texts only; not launched where it isn't a boolean."""
    a = answer if isinstance(answer, dict) else {}
    yes = a.get("launches_node") if isinstance(a.get("launches_node"), bool) else False
    files = a.get("js_files") if isinstance(a.get("js_files"), list) else []
    return {"launches_node": yes, "js_files": [f for f in files if isinstance(f, str)] if yes else []}


def launches_shape(answer: object) -> str | None:
    return None if isinstance(answer, dict) and "launches_node" in answer else "the boolean launches_node is missing"


def routed(df: DataFrame, payload: str, judge: Judge, history: Column | None = None) -> DataFrame:
    """df with `action`, try_enrichment or try_dynamic, the former where the judge says neither, and `why` in words."""
    out = judged(df.withColumn("__p", prompt("route", F.col(payload), history)), "__p", judge, "__a")
    said = F.get_json_object("__a", "$.next_action")
    ok = F.coalesce(said.isin("try_enrichment", "try_dynamic"), F.lit(False))
    reason = F.coalesce(F.get_json_object("__a", "$.reason"), F.lit(""))
    why = F.when(ok, F.concat(F.lit("router chose "), said, F.when(reason != "", F.concat(F.lit(": "), reason)).otherwise(""))).otherwise("router fallback: try_enrichment")
    return out.withColumn("action", F.when(ok, said).otherwise("try_enrichment")).withColumn("why", why).drop("__p", "__a")


def too_long(tokens: Column, most: int = 127_000) -> Column:
    """Whether a prompt of so many tokens, as the judge's own tokenizer counts them, is more than it takes."""
    return tokens > most


def stub(prompt: str) -> str:
    """A deterministic judge for tests: by what a text names."""
    low = prompt.lower()
    verdict = "malicious" if "password" in low or "secret" in low else "undetermined" if "http" in low else "benign"
    return json.dumps({"judgement": verdict, "words": len(prompt.split())})
