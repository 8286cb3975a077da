"""What registries, repositories and caches say of packages. Null in, null out, but where said."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def repo_url(raw: Column) -> Column:
    """A manifest's repository address as one for the web, without .git, query and fragment; null where it isn't http then."""
    s = F.regexp_replace(F.regexp_extract(F.trim(raw), r"^(\S+)", 1), r"^(git\+)+", "")
    s = F.regexp_extract(s, r"^([^#?]*)", 1)
    s = F.regexp_replace(s, r"(?i)^github:([^/]+/[^/]+)$", "https://github.com/$1")
    s = F.regexp_replace(s, r"(?i)^(ssh://)?git@github\.com[:/](.+)$", "https://github.com/$2")
    s = F.regexp_replace(s, r"(?i)^(git|ssh)://", "https://")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)\.git$", ""), r"/+$", "")
    return F.when(s.rlike(r"(?i)^https?://"), s)


def owner_repo(link: Column) -> Column:
    """owner/name of a repository's address; null for other hosts."""
    return F.nullif(F.regexp_extract(link, r"github\.com/([^/]+/[^/]+)", 1), F.lit(""))


def last_page(link_header: Column, items: Column) -> Column:
    """How many items there are, asked for one a page: the last page's number, else the items of the only one."""
    found = F.regexp_extract(link_header, r'[&?]page=(\d+)>;\s*rel="last"', 1)
    return F.when(F.coalesce(found, F.lit("")) != "", found.cast("long")).otherwise(items.cast("long"))


def declaration_path(path: Column) -> Column:
    """A manifest's path of types as one within the package; null unless it ends in .d.ts."""
    p = F.regexp_replace(F.regexp_replace(F.trim(path), r"^(\./)+", ""), r"^/+", "")
    return F.when(p.rlike(r"\.d\.ts$"), p)


def recent_release(changelog: Column, as_of: Column, months: int = 12) -> Column:
    """Whether a version (no entry named created or modified) is newer than as_of less months of 30 days. changelog maps versions
    to times in ISO 8601, those without a zone in UTC; other texts don't count. Null: false."""
    since = as_of - F.make_dt_interval(F.lit(30 * months))
    newer = F.map_filter(changelog, lambda k, v: ~k.isin("created", "modified") & F.coalesce(F.try_to_timestamp(v) > since, F.lit(False)))
    return F.coalesce(F.size(newer) > 0, F.lit(False))


def trust_rule(downloads: Column, has_repository: Column, versions: Column, readme: Column, recent: Column, dependents: Column) -> Column:
    """trusted, untrusted or ask (the judge): by many downloads with repository, three versions, a readme and a recent release; else by
    many dependents; else not without readme text or repository."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    solid = yes(downloads > 10000) & yes(has_repository) & yes(versions >= 3) & readme.isNotNull() & yes(recent)
    return F.when(solid | yes(dependents > 10000), "trusted").when(F.coalesce(readme == "", F.lit(True)) | ~yes(has_repository), "untrusted").otherwise("ask")


def known(value: Column) -> Column:
    """A judge's text, null for the word unknown."""
    return F.nullif(value, F.lit("unknown"))


def cache_key(name: Column) -> Column:
    return F.sha2(name, 256)


def lock_offset(name: Column) -> Column:
    """A key's place among 2^31: the first 64 bits of its digest, modulo that."""
    return F.conv(F.substring(F.sha2(name, 256), 9, 8), 16, 10).cast("long") % (1 << 31)


def flag(text: Column) -> Column:
    """yes, true, t, y and 1, no, false, f, n and 0, in any case, as a boolean; null for others."""
    t = F.lower(text)
    return F.when(t.isin("yes", "true", "t", "y", "1"), True).when(t.isin("no", "false", "f", "n", "0"), False)


_MARKS = (
    (re.compile(r"(?ms)^(```|~~~).*?^\1[ \t]*$"), lambda m: m[0].split("\n", 1)[-1].rsplit("\n", 1)[0]),
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"),
    (re.compile(r"\[([^\]]+)\]\([^)]*\)"), r"\1"),
    (re.compile(r"(?m)^ {0,3}#{1,6}[ \t]+(.*?)[ \t]*#*$"), r"\1"),
    (re.compile(r"(?m)^ {0,3}> ?"), ""),
    (re.compile(r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+"), ""),
    (re.compile(r"(?m)^ {0,3}(?:[-*_][ \t]*){3,}$"), ""),
    (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"\2"),
    (re.compile(r"(?<![\w*])[*_](?=\S)([^*_\n]+?)(?<=\S)[*_](?![\w*])"), r"\1"),
    (re.compile(r"`([^`\n]+)`"), r"\1"),
    (re.compile(r"<[^>\n]+>"), ""),
    (re.compile(r"\n\s*\n\s*\n+"), "\n\n"),
)


@F.pandas_udf(T.StringType())
def plain_text(markdown: pd.Series) -> pd.Series:
    """Markdown without its marks: the text of headings, lists, links, emphasis and code; no more than one empty line in a row."""

    def strip(x: str) -> str:
        for pattern, with_ in _MARKS:
            x = pattern.sub(with_, x)
        return x.strip("\n")

    return markdown.map(lambda x: strip(x) if isinstance(x, str) else None)


_COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*", re.S)
_BLOCKS, _CHARS = 12, 4000


def method_evidence(code: str | None, method: str | None) -> str | None:
    """Declarations of a method in a TypeScript declaration file, each with the comment right before it: up to twelve distinct
    blocks in their order, cut at 4000 characters. Null where there is none."""
    if not code or not method:
        return None
    head = r"(?:(?:export|declare|default|abstract|public|protected|private|static|readonly|async|function|get|set)\s+)*"
    bare = _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    name = re.compile(rf"(?m)(?:^|(?<=[;{{}},]))[ \t]*({head}{re.escape(method)}\??\s*[(:<])")
    comments = [(m.start(), m.end(), m[0]) for m in _COMMENT.finditer(code)]
    blocks: list[str] = []
    for m in name.finditer(bare):
        at, depth, end = m.start(1), 0, m.end() - 1
        while end < len(bare):
            c = bare[end]
            if c == ">" and bare[end - 1] == "=":
                pass
            elif c in "([{<":
                depth += 1
            elif c in ")]}>":
                if not depth:
                    break
                depth -= 1
            elif not depth and (c in ";," or (c == "\n" and bare[at:end].rstrip()[-1:] not in ":|&=(,")):
                break
            end += 1
        text = code[at : end + (bare[end : end + 1] == ";")].strip()
        before = next((c for s, e, c in reversed(comments) if e <= at and not code[e:at].strip()), None)
        block = f"{before.strip()}\n{text}" if before else text
        if block not in blocks:
            blocks.append(block)
        if len(blocks) == _BLOCKS:
            break
    out = "\n\n".join(blocks)
    return (out[:_CHARS].rstrip() + "\n/* ...truncated... */" if len(out) > _CHARS else out) or None


@F.pandas_udf(T.StringType())
def declared_evidence(files: pd.Series, first: pd.Series, method: pd.Series) -> pd.Series:
    """method_evidence() of the first of a package's declaration files (arrays of path and text) that has any, those whose paths
    are in `first` before the others."""

    def one(fs, paths, m) -> str | None:
        if fs is None or m is None:
            return None
        text = {f["path"]: f["text"] for f in fs}
        order = [p for p in (paths if paths is not None else []) if p in text]
        return next((e for p in dict.fromkeys([*order, *text]) if (e := method_evidence(text[p], m))), None)

    return pd.Series([one(*r) for r in zip(files, first, method, strict=True)], dtype=object)
