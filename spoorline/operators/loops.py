"""Judges that read files in turns. Each item (a shell command, an entry, a component) is one row; its turns run in one task, and
what they can read is the package's files, joined to the row.

The files of a package are a map of paths to texts, bounded by what one package ships. A judge answers a turn with JSON: an action
read_files with paths, or final with its verdict.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import BINARY_EXTENSIONS, INDEX_FILES, READABLE_EXTENSIONS, SCRIPT_EXTENSIONS
from ..sources.files import MAGIC
from .model import Judge, answered, asked

#: Bounds of the loops: fixed values. Turns that read, files a turn, files in all.
SHELL, FALLBACK, REREAD = (2, 5, 8), (3, 5, 12), 3
#: What a shell command's judge isn't shown, as others read it: fixed values.
PROGRAMS = ("js", "cjs", "mjs")
_NODE = re.compile(r"\bnode\s+((?:[\w./-]+\.(?:js|cjs|mjs)\s*)+)")
LABELS, JUDGEMENTS = ("benign", "warning", "malicious"), ("benign", "malicious", "undetermined")


def _extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem.strip(".") else ""


def _normal(path: str) -> str | None:
    """Without . and .. parts; None where it leads out of the package."""
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def is_binary(text: str) -> bool:
    head = text[:1024]
    return "\0" in head or sum(c > "\x7f" for c in head) > 0.3 * max(len(head), 1)


@dataclass
class Reader:
    """The files of one package, and which of them were served."""

    files: dict[str, str]
    visited: set[str] = field(default_factory=set)
    readable: tuple[str, ...] = tuple(READABLE_EXTENSIONS)

    def resolve(self, path: str) -> str | None:
        """The file that a path means: itself, an index file below it, or, without an extension, with one of the readable ones."""
        p = _normal(path) if path and not path.startswith("/") else None
        if p is None:
            return None
        below = [f"{p}/{i}" if p else i for i in INDEX_FILES]
        if any(f.startswith(f"{p}/") for f in self.files) or not p:
            names = below
        else:
            names = [p, *(f"{p}.{e}" for e in self.readable), *below] if not _extension(p) else [p]
        return next((n for n in names if n in self.files), None)

    def kind(self, path: str) -> str:
        """binary, script or unknown, by the extension, and where that says nothing by the first eight bytes."""
        ext = _extension(path.strip())
        if ext in BINARY_EXTENSIONS:
            return "binary"
        if ext in SCRIPT_EXTENSIONS:
            return "script"
        found = self.resolve(path)
        if found is None:
            return "unknown"
        head = self.files[found][:8].encode("latin-1", "replace")[:8]
        return "binary" if b"\0" in head or head.hex().upper().startswith(MAGIC) else "script"

    def is_module(self, path: str) -> bool:
        if path.startswith(("./", "../", "/")):
            return False
        return path.startswith("@") or ("/" not in path and not path.endswith(tuple(f".{e}" for e in self.readable)))

    def is_command(self, path: str) -> bool:
        return not path.startswith(("./", "../")) and "/" not in path and not path.endswith(tuple(f".{e}" for e in self.readable))

    def read(self, requested: list, most: int, in_all: int, refused: tuple[str, ...] = (), commands: bool = False) -> list[dict]:
        """A result for each of the first `most` requested paths: status budget_exhausted, out_of_scope, not_found, already_visited,
        binary, or ok with its content."""
        out = []
        for path in [p.strip() for p in requested if isinstance(p, str) and p.strip()][:most]:
            if len(self.visited) >= in_all:
                out.append({"path": path, "status": "budget_exhausted"})
            elif (self.is_command if commands else self.is_module)(path) or path.startswith("/") or _extension(path) in refused:
                out.append({"path": path, "status": "out_of_scope"})
            elif (found := self.resolve(path)) is None:
                out.append({"path": path, "status": "not_found"})
            elif found in self.visited:
                out.append({"path": path, "resolved_path": found, "status": "already_visited"})
            else:
                self.visited.add(found)
                text = self.files[found]
                out.append({"path": path, "resolved_path": found, "status": "binary"} if is_binary(text) else {"path": path, "resolved_path": found, "status": "ok", "content": text})
        return out


def _action(answer: object) -> tuple[str, str]:
    if not isinstance(answer, dict) or "action" not in answer:
        return "invalid", "the answer is neither of the two JSON shapes read_files and final"
    return (answer["action"], "") if answer["action"] in ("final", "read_files") else ("invalid", f"unknown action {answer['action']!r}")


def in_turns(ask: Callable[[dict], object], read: Callable[[list], list[dict]], payload: dict, hops: int, visited: Callable[[], list[str]]) -> tuple[str, object]:
    """(how it ended, the final answer or what was wrong): final, lost, invalid or stubborn.

    A turn's payload holds the turns before it without their files' texts, and the last one's files whole. After `hops` reading
    turns a final answer is demanded once. Two invalid answers in a row end it, a lost judge at once.
    """
    turn, used, forced, wrong, bad = 1, 0, False, None, 0
    before: list[dict] = []
    results: list[dict] = []
    synthesis = ""
    while True:
        left = 0 if forced else hops - used
        body = {**payload, "turn": turn, "remaining_hops": left, "visited_files": visited()}
        if turn > 1:
            body |= {"prior_reads": before, "read_results": results, "running_synthesis": synthesis}
        if wrong:
            body["previous_response_error"] = wrong
        try:
            answer = ask(body)
        except Exception as e:  # whatever the judge raises
            return "lost", str(e)
        kind, wrong = _action(answer)
        if kind == "invalid":
            bad += 1
            if bad == 2:
                return "invalid", wrong
            continue
        bad, wrong = 0, None
        if kind == "final":
            return "final", answer
        if forced:
            return "stubborn", "more files were asked for after the last hop"
        paths = answer.get("paths") if isinstance(answer.get("paths"), list) else []
        new = answer.get("running_synthesis")
        synthesis = new if isinstance(new, str) and new.strip() else synthesis
        if left <= 0:
            results, forced, served = [{"status": "budget_exhausted", "note": "answer with action final now"}], True, []
        else:
            results = read([p for p in paths if isinstance(p, str) and p.strip()])
            served = [{k: v for k, v in r.items() if k != "content"} for r in results]
            used += 1
        before = [*before, {"turn": turn, "requested_paths": paths, "served_summary": served, "observations": answer.get("observations") or ""}]
        turn += 1


def _asker(judge: Judge, name: str, history: str) -> Callable[[dict], object]:
    return lambda body: answered(judge, asked(name, json.dumps(body, ensure_ascii=False), history), repairs=0)


def judge_command(judge: Judge, command: str, files: dict[str, str]) -> tuple[str, str, list[str]]:
    """(label, explanation, script files it runs) of an install command; a warning without words where the judge fails."""
    hops, a_turn, in_all = SHELL
    reader = Reader(files)
    how, answer = in_turns(_asker(judge, "shell_command", ""), lambda p: reader.read(p, a_turn, in_all, PROGRAMS, True), {"shell_command": command}, hops, lambda: sorted(reader.visited))
    if how != "final":
        return "warning", "", []
    label, why, ran = answer.get("label", "benign"), answer.get("explanation", ""), answer.get("executed_js_files", [])
    return label if label in LABELS else "warning", why if isinstance(why, str) else str(why), [f for f in ran if isinstance(f, str) and f.strip()] if isinstance(ran, list) else []


def judge_entry(judge: Judge, entry: str, files: dict[str, str], history: str = "") -> tuple[str, str, list[dict], list[str]]:
    """(judgement, reason, key_evidence, files served) of an entry that there is no graph of; undetermined where it can't be read
    or the judge fails."""
    hops, a_turn, in_all = FALLBACK
    reader = Reader(files)
    found = reader.resolve(entry)
    if found is None:
        return "undetermined", f"entry file {entry} could not be resolved inside the package", [], []
    if is_binary(files[found]):
        return "undetermined", f"entry file {found} is binary; static review skipped", [], []
    reader.visited.add(found)
    body = {"entry_file": found, "entry_content": files[found]}
    how, answer = in_turns(_asker(judge, "static_fallback", history), lambda p: reader.read(p, a_turn, in_all), body, hops, lambda: sorted(reader.visited))
    served = sorted(p for p in reader.visited if not is_binary(files[p]))
    if how != "final":
        return "undetermined", str(answer), [], served
    reason, evidence = answer.get("reason", ""), answer.get("key_evidence", [])
    verdict = answer.get("judgement", "undetermined")
    return verdict if verdict in JUDGEMENTS else "undetermined", reason if isinstance(reason, str) else str(reason), [e for e in evidence if isinstance(e, dict)] if isinstance(evidence, list) else [], served


def first_binary(reader: Reader, requested: list[str]) -> tuple[str, str] | None:
    """(path, how it was told) of the first requested path that is a native binary."""
    for path in requested:
        if (kind := reader.kind(path)) == "binary":
            return path, "extension" if _extension(path.strip()) in BINARY_EXTENSIONS else "magic_peek"
        if kind == "unknown":
            continue
    return None


def probed(reader: Reader, requested: list[str], binary: str | None = None) -> list[dict]:
    """Which requested paths are there, without reading them."""
    return [{"path": p, "status": "not_found" if reader.resolve(p) is None else "binary" if p == binary else "found"} for p in requested]


def _cleaned(paths: object) -> list[str]:
    out: list[str] = []
    for p in paths if isinstance(paths, list) else []:
        if isinstance(p, str):
            x = p.strip()
            y = x.removeprefix("./")
            own = y.removeprefix("package").lstrip("/") if y == "package" or y.startswith("package/") else x
            if (own or x) and (own or x) not in out:
                out.append(own or x)
    return out


def overlay(prior: dict, reread: object, last: bool, dynamic: bool) -> dict:
    """A report with the valid fields of a second reading over it; see verdict.overlaid()."""
    if not isinstance(reread, dict):
        return {k: v for k, v in prior.items() if k != "files_to_read"}
    verdict = reread.get("judgement") if reread.get("judgement") in JUDGEMENTS else prior.get("judgement", "undetermined")
    words = lambda k: reread[k] if isinstance(reread.get(k), str) and reread[k].strip() else prior.get(k, "")
    listed = lambda k: reread[k] if isinstance(reread.get(k), list) else None
    if dynamic:
        out = {"judgement": verdict, "explanation": words("explanation")}
    else:
        evidence = listed("key_evidence")
        out = {"judgement": verdict, "key_evidence": prior.get("key_evidence", []) if evidence is None else evidence, "reason": words("reason"), "node_to_be_checked": (listed("node_to_be_checked") or []) if verdict == "undetermined" else []}
    files = [] if last else _cleaned(reread.get("files_to_read"))
    return {**out, "files_to_read": files} if files else out


def binary_report(prior: dict, path: str, dynamic: bool) -> dict:
    """The verdict on code that hands control to a native binary: see verdict.binary_verdict()."""
    words = f"hands control to the native binary `{path}`, which can't be read; malicious by policy"
    if dynamic:
        return {"judgement": "malicious", "explanation": words}
    numbers = [x for x in (_number(n) for n in [*(prior.get("node_to_be_checked") or []), *(e.get("node_id") for e in prior.get("key_evidence") or [] if isinstance(e, dict))]) if x is not None]
    kind = next((e["node_type"] for e in prior.get("key_evidence") or [] if isinstance(e, dict) and numbers and _number(e.get("node_id")) == numbers[0] and isinstance(e.get("node_type"), str)), "unresolved")
    evidence = [{"node_id": numbers[0], "node_type": kind, "claim": f"spawns the native binary `{path}`, which can't be read; malicious by policy"}] if numbers else []
    return {"judgement": "malicious", "key_evidence": evidence, "reason": words, "node_to_be_checked": []}


def _number(x: object) -> int | None:
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


def reread(judge: Judge, slice_: str, report: dict, files: dict[str, str], history: str = "", dynamic: bool = False, evidence: str | None = None) -> tuple[dict, list[dict]]:
    """(report, steps): a component's report after at most REREAD readings of the files it asks for. A native binary among them
    makes it malicious at once; where nothing readable comes, or the judge fails, what is known stays."""
    reader, reads, steps, now = Reader(files), [], [], report
    name = "dynamic_reread" if dynamic else "static_reread"
    for hop in range(1, REREAD + 1):
        wanted = [p for p in _cleaned(now.get("files_to_read")) if p not in reader.visited]
        if not wanted:
            break
        if binary := first_binary(reader, wanted):
            now = binary_report(now, binary[0], dynamic)
            steps.append({"hop": hop, "binary": binary[0], "by": binary[1], "reads": probed(reader, wanted, binary[0]), "judgement": "malicious"})
            break
        got = [{**r, "hop": hop} for r in reader.read(wanted, len(wanted), len(wanted) + len(reads))]
        reads += got
        if not any(r["status"] == "ok" for r in reads):
            steps.append({"hop": hop, "reads": got, "judgement": now.get("judgement")})
            break
        body = {"hop": hop, "max_hops": REREAD, "remaining_hops": REREAD - hop, "sliced_code": slice_, "prior_report": now, "read_files": reads, **({"evidence": evidence} if dynamic else {})}
        try:
            answer = answered(judge, asked(name, json.dumps(body, ensure_ascii=False), history), repairs=0)
        except Exception:  # whatever the judge raises
            answer = None
        now = overlay(now, answer, hop == REREAD, dynamic)
        steps.append({"hop": hop, "reads": [{k: v for k, v in r.items() if k != "content"} for r in got], "judgement": now.get("judgement")})
        if answer is None:
            break
    return {k: v for k, v in now.items() if k != "files_to_read"}, steps


def _files(x) -> dict[str, str]:
    return dict(x) if x is not None else {}


def with_files(items: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """items with `files`, a map of the paths of their package (by, path, text) to texts."""
    f = files.where("path IS NOT NULL AND text IS NOT NULL").groupBy(*by, "path").agg(F.min("text").alias("text")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("files"))
    return items.join(f, by, "left")


def _rows(df: DataFrame, one: Callable[[dict], tuple], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    keep = [f for f in df.schema.fields if f.name != "files"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [one(r) for r in b.to_dict("records")]
            out = b[[f.name for f in keep]].copy()
            for k, n in enumerate(names):
                out[n] = pd.Series([r[k] for r in found], index=out.index, dtype=object)
            yield out

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return df.mapInPandas(run, f"{head}, {schema}")


def judged_commands(commands: DataFrame, judge: Judge, command: str = "command") -> DataFrame:
    """commands (with files) with label, explanation and executed: the script files that the judge says the command runs; where reading
    itself fails, a warning and those that the command hands to node."""

    def one(r: dict) -> tuple:
        text = r[command] or ""
        try:
            return judge_command(judge, text, _files(r["files"]))
        except Exception:  # files of another shape
            return "warning", "", [m.strip() for m in _NODE.findall(text)]

    return _rows(commands, one, "label string, explanation string, executed array<string>")


def judged_entries(entries: DataFrame, judge: Judge, entry: str = "entry", history: str | None = None) -> DataFrame:
    """entries (with files) with judgement, reason, evidence (JSON) and served."""

    def one(r: dict) -> tuple:
        verdict, reason, evidence, served = judge_entry(judge, r[entry] or "", _files(r["files"]), (r[history] or "") if history else "")
        return verdict, reason, json.dumps(evidence, sort_keys=True), served

    return _rows(entries, one, "judgement string, reason string, evidence string, served array<string>")


def reread_reports(components: DataFrame, judge: Judge, slice_: str = "slice", report: str = "report", dynamic: bool = False) -> DataFrame:
    """components (with files) with their report, JSON, after rereading, and the number of hops."""

    def one(r: dict) -> tuple:
        try:
            before = json.loads(r[report] or "")
        except ValueError:
            before = {}
        out, steps = reread(judge, r[slice_] or "", before if isinstance(before, dict) else {}, _files(r["files"]), dynamic=dynamic)
        return json.dumps(out, sort_keys=True), len(steps)

    return _rows(components, one, "revised string, hops int")


def recorded_step(items: DataFrame, by: list[str], seq: str, stage: str, entry: str, result: str, words: list[str]) -> DataFrame:
    """(by, seq, stage, entry, result, finding): a history's rows of judged items; the finding is what there is of the given texts."""
    texts = [F.nullif(F.col(w), F.lit("")) for w in words]
    label = F.when(F.col(result).isin(*JUDGEMENTS), F.col(result)).otherwise("warning")
    return items.select(*by, F.col(seq).alias("seq"), F.lit(stage).alias("stage"), F.col(entry).alias("entry"), label.alias("result"), F.concat_ws("; ", *texts).alias("finding"))
