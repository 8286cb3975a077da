"""Judges that read files in turns: budgets, statuses, how a loop ends."""

import json

import pytest

from spoorline.operators import loops

FILES = {"a.js": "x", "lib/index.js": "y", "b/c.json": "{}", "run.sh": "s", "n.bin": "\0", "odd": "\x7fELFxx", "é.js": "é" * 10}


def test_resolving():
    r = loops.Reader(FILES)
    assert [r.resolve(p) for p in ("a", "./a.js", "lib", "lib/", "b/../a", "../a.js", "/a.js", "", "b/c", "nope", ".")] == ["a.js", "a.js", "lib/index.js", "lib/index.js", "a.js", None, None, None, "b/c.json", None, None]
    assert [r.kind(p) for p in ("x.exe", "a.js", "odd", "nope", "lib")] == ["binary", "script", "binary", "unknown", "script"]
    assert [r.is_module(p) for p in ("fs", "@a/b", "a.js", "./x", "b/c")] == [True, True, False, False, False]
    assert [r.is_command(p) for p in ("ls", "@a/b", "run.sh", "./x")] == [True, False, False, False]


def test_statuses_in_their_order():
    r = loops.Reader(FILES)
    got = r.read(["fs", "/etc/x", "x.js", "./a", "a.js", "n.bin", "", 3, "lib"], 8, 3)
    assert [(g["path"], g["status"]) for g in got] == [("fs", "out_of_scope"), ("/etc/x", "out_of_scope"), ("x.js", "not_found"), ("./a", "ok"), ("a.js", "already_visited"), ("n.bin", "out_of_scope"), ("lib", "out_of_scope")]
    assert [g["status"] for g in r.read(["./n.bin", "./lib", "b/c.json"], 5, 3)] == ["binary", "ok", "budget_exhausted"]
    assert [g["status"] for g in loops.Reader(FILES).read(["a.js", "run.sh", "ls"], 5, 9, loops.PROGRAMS, True)] == ["out_of_scope", "ok", "out_of_scope"]
    assert len(loops.Reader(FILES).read(["a.js", "lib", "b/c.json"], 2, 9)) == 2


def said(*answers):
    """A judge that gives its answers in order, the last one for ever, and what it was asked."""
    asked = []

    def judge(text):
        asked.append(json.loads(text[text.index("\n\n{") + 2 :]))
        a = answers[min(len(asked), len(answers)) - 1]
        if isinstance(a, Exception):
            raise a
        return a if isinstance(a, str) else json.dumps(a)

    return judge, asked


READ, FINAL = {"action": "read_files", "paths": ["./run.sh"]}, {"action": "final", "label": "benign", "judgement": "benign", "explanation": "e", "reason": "r", "executed_js_files": ["a.js", "", 2]}


def test_commands():
    judge, asked = said(READ, FINAL)
    assert loops.judge_command(judge, "sh run.sh", FILES) == ("benign", "e", ["a.js"])
    assert asked[1]["read_results"][0]["content"] == "s" and "content" not in asked[1]["prior_reads"][0]["served_summary"][0] and asked[1]["visited_files"] == ["run.sh"]
    judge, asked = said(READ)  # never ends of itself: two readings, a forced turn, and no more
    assert loops.judge_command(judge, "x", FILES) == ("warning", "", []) and [a["remaining_hops"] for a in asked] == [2, 1, 0, 0]
    assert asked[-1]["read_results"][0]["status"] == "budget_exhausted"
    judge, asked = said("no JSON", {"action": "dance"})
    assert loops.judge_command(judge, "x", FILES) == ("warning", "", []) and "JSON shapes" in asked[1]["previous_response_error"]
    judge, _ = said({"action": "final", "label": "odd", "explanation": 3})
    assert loops.judge_command(judge, "x", FILES) == ("warning", "3", [])


def test_entries(monkeypatch):
    monkeypatch.setattr(loops, "answered", lambda j, t, **k: json.loads(j(t)))
    judge, asked = said({"action": "read_files", "paths": ["./lib"], "running_synthesis": "so far"}, {**FINAL, "judgement": "malicious", "key_evidence": [{"claim": "c"}, 1]})
    assert loops.judge_entry(judge, "a", FILES) == ("malicious", "r", [{"claim": "c"}], ["a.js", "lib/index.js"]) and asked[1]["running_synthesis"] == "so far"
    assert loops.judge_entry(judge, "gone", FILES)[0] == loops.judge_entry(judge, "n.bin", FILES)[0] == "undetermined"
    judge, _ = said(ConnectionError("down"))
    assert loops.judge_entry(judge, "a", FILES)[:2] == ("undetermined", "down")


@pytest.mark.parametrize("dynamic", [False, True])
def test_rereading(dynamic):
    judge, asked = said({"judgement": "malicious", "reason": " ", "explanation": "new", "key_evidence": [], "files_to_read": ["package/a.js", "lib"]}, {"judgement": "odd", "files_to_read": ["b/c.json"]}, {"judgement": "benign"})
    first = {"judgement": "undetermined", "reason": "old", "explanation": "old", "key_evidence": [1], "node_to_be_checked": ["5"], "files_to_read": ["./run.sh"]}
    out, steps = loops.reread(judge, "slice", first, FILES, dynamic=dynamic)
    assert out["judgement"] == "benign" and len(steps) == 3 and "files_to_read" not in out and [len(a["read_files"]) for a in asked] == [1, 3, 4]
    assert out.get("explanation") == ("new" if dynamic else None) and out.get("reason") == (None if dynamic else "old")
    out, steps = loops.reread(judge, "s", {**first, "files_to_read": ["x.node"]}, FILES, dynamic=dynamic)
    assert out["judgement"] == "malicious" and steps[0]["by"] == "extension" and (dynamic or out["key_evidence"][0]["node_id"] == 5)
    out, steps = loops.reread(judge, "s", {**first, "files_to_read": ["nope.js"]}, FILES, dynamic=dynamic)
    assert out["judgement"] == "undetermined" and steps[0]["reads"][0]["status"] == "not_found"
    assert loops.reread(judge, "s", {"judgement": "benign"}, {}, dynamic=dynamic) == ({"judgement": "benign"}, [])
    judge, _ = said(OSError())
    assert loops.reread(judge, "s", first, FILES, dynamic=dynamic)[0]["judgement"] == "undetermined"


def test_probing():
    assert [p["status"] for p in loops.probed(loops.Reader(FILES), ["a", "nope", "x.exe", "n.bin"], "n.bin")] == ["found", "not_found", "not_found", "binary"]
