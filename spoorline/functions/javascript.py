"""JavaScript text as tokens, and what can be told from them without a syntax tree."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Token(NamedTuple):
    """kind: name, number, string, template, regex or punct; the text from start to end."""

    kind: str
    text: str
    start: int
    end: int


_SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|$))+", re.S)
_NAME = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r"""'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*\"""", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_PUNCT = re.compile(r"\.\.\.|>>>=|[*&|?<>]{2}=|===|!==|>>>|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|<<|>>|\*\*|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
#: Words after which a slash begins a pattern, not a division: fixed names.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof await yield".split())


def tokens(code: str) -> Iterator[Token]:
    """The tokens of a text; a template is one token, whatever stands in it. Characters that begin none are passed over."""
    at, last = 0, None
    while at < len(code):
        if m := _SKIP.match(code, at):
            at = m.end()
            continue
        c = code[at]
        if c == "`":
            end = _template_end(code, at)
            t = Token("template", code[at:end], at, end)
        elif m := _NAME.match(code, at):
            t = Token("name", m[0], at, m.end())
        elif (c.isdigit() or (c == "." and code[at + 1 : at + 2].isdigit())) and (m := _NUMBER.match(code, at)):
            t = Token("number", m[0], at, m.end())
        elif m := _STRING.match(code, at):
            t = Token("string", m[0], at, m.end())
        elif c == "/" and (last is None or (last.kind == "punct" and last.text not in (")", "]", "}", "++", "--")) or (last.kind == "name" and last.text in _BEFORE_REGEX)) and (m := _REGEX.match(code, at)):
            t = Token("regex", m[0], at, m.end())
        elif m := _PUNCT.match(code, at):
            t = Token("punct", m[0], at, m.end())
        else:
            at += 1
            continue
        yield t
        at, last = t.end, t


def _template_end(code: str, at: int) -> int:
    """Behind the backquote that ends the template at `at`; templates and braces within it are passed over."""
    at, depth = at + 1, []  # what is open: braces of ${...}, counted
    while at < len(code):
        c = code[at]
        if c == "\\":
            at += 1
        elif not depth and c == "`":
            return at + 1
        elif not depth and code.startswith("${", at):
            depth.append("{")
            at += 1
        elif depth:
            if c == "`":
                at = _template_end(code, at) - 1
            elif c in "'\"" and (m := _STRING.match(code, at)):
                at = m.end() - 1
            elif c == "{":
                depth.append("{")
            elif c == "}":
                depth.pop()
        at += 1
    return len(code)


#: Operators of two sides, and assignments of one sign: an eval beside one is no statement of its own. Fixed signs.
_BINARY = frozenset("+ - * / % ** << >> >>> & | ^ && || ?? == != === !== < > <= >= in instanceof".split())


def eval_calls(code: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, text, isolated) of the calls of eval that are given plain strings alone, joined in order. isolated: its value
    goes into no call, operation, assignment or return. Strings that are empty or have escapes in them aren't plain."""
    ts = list(tokens(code))
    out = []
    for i, t in enumerate(ts):
        if t.text != "eval" or t.kind != "name" or i + 1 >= len(ts) or ts[i + 1].text != "(" or (i and ts[i - 1].text in (".", "?.", "function")):
            continue
        j, parts, plain = i + 2, [], True
        while j < len(ts) and ts[j].text != ")":
            x = ts[j]
            if x.kind == "string" and len(x.text) > 2 and "\\" not in x.text:
                parts.append(x.text[1:-1])
            elif x.text not in ("+", ","):
                plain = False
                break
            j += 1
        if not plain or j == len(ts) or not parts:
            continue
        before, after = ts[i - 1].text if i else "", ts[j + 1] if j + 1 < len(ts) else None
        used = before in _BINARY or before in ("=", "return") or (after is not None and (after.text in _BINARY or after.text == "(" or after.kind == "template"))
        out.append((t.start, ts[j].end, "".join(parts), not used))
    return out


def inlined(code: str) -> str:
    """The text with every isolated eval of plain strings as a call of a function that holds them, which is written below it."""
    calls = [c for c in eval_calls(code) if c[3]]
    if not calls:
        return code
    parts, at, functions = [], 0, []
    for k, (start, end, text, _) in enumerate(calls, 1):
        parts += [code[at:start], f"eval_wrap_{k}()"]
        functions.append(f"function eval_wrap_{k}() {{\n{text};\n}}")
        at = end
    return "".join([*parts, code[at:]]) + "\n\n" + "\n\n".join(functions) + "\n"


@F.pandas_udf(T.StringType())
def evals_inlined(code: pd.Series) -> pd.Series:
    """inlined() of each text; null stays null."""
    return code.map(lambda x: inlined(x) if isinstance(x, str) else None)


_CLOSE = {"(": ")", "[": "]", "{": "}"}
#: Words that stand before a bracket without being called: fixed names.
_NO_CALLEE = frozenset("if for while switch catch with function return typeof await yield in of new delete void throw case do else instanceof".split())


def nodes(code: str) -> list[tuple[str, str, int, int]]:
    """(type, name, start, end) of the calls, constructions, member accesses and functions of a text, by their first character and
    the one behind the last. A call starts where the chain of members that it calls does. Text that doesn't close its
    brackets gives what is closed."""
    ts = list(tokens(code))
    match: dict[int, int] = {}
    stack: list[int] = []
    for i, t in enumerate(ts):
        if t.kind == "punct" and t.text in _CLOSE:
            stack.append(i)
        elif t.kind == "punct" and t.text in ")]}":
            while stack and _CLOSE[ts[stack[-1]].text] != t.text:
                stack.pop()
            if stack:
                match[stack.pop()] = i
    out: list[tuple[str, str, int, int]] = []
    body = {}  # the brackets of a function's parameters
    for i, t in enumerate(ts):
        if t.kind == "name" and t.text == "function":
            j = i + 1
            while j < len(ts) and ts[j].text in ("*",):
                j += 1
            name = ts[j].text if j < len(ts) and ts[j].kind == "name" else ""
            j += bool(name)
            if j in match and match[j] + 1 in match and ts[match[j] + 1].text == "{":
                out.append(("function", name, t.start, ts[match[match[j] + 1]].end))
                body[j] = True
        elif t.text == "=>":
            k = i + 1
            if k in match and ts[k].text == "{":
                first = i - 1
                if ts[first].text == ")":
                    first = next((a for a, b in match.items() if b == first), first)
                    body[first] = True
                out.append(("arrow_function", "", ts[first].start, ts[match[k]].end))
    i = 0
    while i < len(ts):
        t = ts[i]
        starts = (t.kind == "name" and (t.text not in _NO_CALLEE or t.text == "new")) or (t.text == "(" and i in match and (i == 0 or not (ts[i - 1].kind in ("name", "string", "template") and ts[i - 1].text not in _NO_CALLEE) and ts[i - 1].text not in (")", "]")) and i not in body)
        after_member = i and ts[i - 1].text in (".", "?.", "function")
        if not starts or after_member:
            i += 1
            continue
        new = t.text == "new" and t.kind == "name"
        j = i + 1 if new else i
        if j >= len(ts):
            break
        name, end, fresh, base = (ts[j].text if ts[j].kind == "name" else ""), j, new, ts[j].start
        if ts[j].text == "(":
            end = match.get(j, j)
        k = end + 1
        while k < len(ts):
            if ts[k].text in (".", "?.") and k + 1 < len(ts) and ts[k + 1].kind == "name":
                name, k = f"{name}.{ts[k + 1].text}", k + 2
                out.append(("member_expression", name, base, ts[k - 1].end))
            elif ts[k].text == "[" and k in match:
                name, k = f"{name}[]", match[k] + 1
                out.append(("subscript_expression", name, base, ts[k - 1].end))
            elif ts[k].text == "(" and k in match and k not in body and not (match[k] + 1 < len(ts) and ts[match[k] + 1].text in ("=>", "{") and not fresh and k == j + 1):
                out.append(("new_expression" if fresh else "call_expression", name, t.start if fresh else base, ts[match[k]].end))
                name, k, fresh, base = f"{name}()", match[k] + 1, False, t.start if fresh else base
            else:
                break
        i = j + 1
    return sorted(set(out), key=lambda n: (n[2], -n[3], n[0]))


NODES = "array<struct<type:string,name:string,start:int,end:int,sl:int,sc:int,el:int,ec:int>>"


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("type", T.StringType()), ("name", T.StringType()), *((c, T.IntegerType()) for c in ("start", "end", "sl", "sc", "el", "ec")))])))
def syntax(code: pd.Series) -> pd.Series:
    """nodes() of each text, with lines and columns from 0; null gives none."""

    def one(x) -> list[dict]:
        if not isinstance(x, str):
            return []
        breaks = [-1, *(m.start() for m in re.finditer("\n", x))]

        def place(at: int) -> tuple[int, int]:
            line = bisect.bisect_left(breaks, at) - 1
            return line, at - breaks[line] - 1

        rows = []
        for type_, name, start, end in nodes(x):
            (sl, sc), (el, ec) = place(start), place(end)
            rows.append({"type": type_, "name": name, "start": start, "end": end, "sl": sl, "sc": sc, "el": el, "ec": ec})
        return rows

    return code.map(one)
