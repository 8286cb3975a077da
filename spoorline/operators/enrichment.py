"""What is known of third-party modules, fetched once each, and what that tells of the nodes that use them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("fully_enriched", "module_only", "api_only", "not_enriched")


def needed_modules(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, module): the distinct modules that nodes name."""
    return nodes.where("module <> ''").select(*by, "module").distinct()


def enriched(nodes: DataFrame, metadata: DataFrame, by: list[str]) -> DataFrame:
    """nodes (by, node, module, property) with module_behavior, api_behavior and level: fully_enriched, module_only, api_only, or
    not_enriched where the module isn't known, isn't trusted, or says nothing of itself and the call.

    metadata (module, trusted, module_behavior, api_behavior: map of properties to texts). A text unknown is none.
    """
    m = metadata.select("module", F.col("trusted").alias("__t"), F.nullif("module_behavior", F.lit("unknown")).alias("__m"), F.col("api_behavior").alias("__a"))
    j = nodes.join(m, "module", "left")
    ok = F.coalesce("__t", F.lit(False))
    module, api = F.when(ok, F.nullif("__m", F.lit(""))), F.when(ok, F.nullif(F.nullif(F.element_at("__a", F.col("property")), F.lit("unknown")), F.lit("")))
    level = F.when(module.isNotNull() & api.isNotNull(), LEVELS[0]).when(module.isNotNull(), LEVELS[1]).when(api.isNotNull(), LEVELS[2]).otherwise(LEVELS[3])
    return j.select(*nodes.columns, module.alias("module_behavior"), api.alias("api_behavior"), level.alias("level"))


def summary(levels: DataFrame, by: list[str]) -> DataFrame:
    """(by, summary): the modules, and each level's nodes in order, in one line; levels without nodes aren't named."""
    agg = [F.concat(F.lit("modules: "), F.array_join(F.array_sort(F.collect_set("module")), ", ")).alias("m")]
    agg += [F.array_sort(F.collect_set(F.when(F.col("level") == x, F.col("node")))).alias(x) for x in LEVELS]
    part = lambda x: F.when(F.size(x) > 0, F.concat(F.lit(f"{x}: nodes ["), F.array_join(F.col(x).cast("array<string>"), ", "), F.lit("]")))
    return levels.groupBy(*by).agg(*agg).select(*by, F.concat_ws(" | ", "m", *[part(x) for x in LEVELS]).alias("summary"))


def fetched(wanted: DataFrame, cache: DataFrame, fetch: Callable[[str], str | None], key: str = "module", payload: str = "data") -> DataFrame:
    """The cache (key, payload) with a row for each wanted key: those that it lacks are fetched, each once however often it is
    wanted, and one that there is nothing of, or that fails, is a row with null. `fetch` gives JSON text or null."""
    missing = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k in b[key]:
                try:
                    out.append(fetch(k))
                except Exception:  # one module's failure is its own
                    out.append(None)
            yield pd.DataFrame({key: b[key], payload: pd.Series(out, dtype=object)})

    return cache.select(key, payload).unionByName(missing.mapInPandas(run, f"{key} string, {payload} string"))


#: What is kept of a module, as JSON in the cache.
METADATA = "version string, description string, keywords array<string>, versions array<string>, repository string, changelog map<string,string>, readme string, types array<string>"


def registry_metadata(text: Column) -> Column:
    """A registry's JSON answer on a module as METADATA; null where it isn't JSON. Types are the paths of declaration files, from
    types, typings and every "types" within exports."""
    from ..functions import declaration_path, repo_url

    v = F.try_parse_json(text)
    get = lambda p, t="string": F.try_variant_get(v, p, t)
    repo = F.coalesce(get("$.repository.url"), F.when(~F.startswith(F.coalesce(get("$.repository"), F.lit("{")), F.lit("{")), get("$.repository")))
    inner = F.transform(F.regexp_extract_all(F.to_json(get("$.exports", "variant")), F.lit(r'"types":"([^"]*)"'), F.lit(1)), lambda p: declaration_path(p))
    types = F.filter(F.array_distinct(F.concat(F.array(declaration_path(get("$.types")), declaration_path(get("$.typings"))), F.coalesce(inner, F.array().cast("array<string>")))), lambda p: p.isNotNull())
    fields = [get("$.version"), get("$.description"), get("$.keywords", "array<string>"), get("$.versions", "array<string>"), repo_url(repo), get("$.time", "map<string,string>"), get("$.readme"), types]
    return F.when(v.isNotNull(), F.struct(*[f.alias(n.split()[0]) for f, n in zip(fields, METADATA.split(", "), strict=True)]))


def repository_metadata(repo: Column, commits_link: Column, commits: Column, contributors_link: Column, contributors: Column) -> Column:
    """struct(stars, forks, commits_number, contributors_number) of a code host's JSON answers and the headers that say how many
    pages there are."""
    from ..functions import last_page

    v = F.try_parse_json(repo)
    count = lambda link, items: last_page(link, F.json_array_length(items)).cast("string")
    return F.struct(F.try_variant_get(v, "$.stargazers_count", "string").alias("stars"), F.try_variant_get(v, "$.forks_count", "string").alias("forks"), count(commits_link, commits).alias("commits_number"), count(contributors_link, contributors).alias("contributors_number"))


def weekly_downloads(text: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(text), "$.downloads", "bigint")


def dependents(text: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(text), "$.dependent_packages_count", "bigint")


def derived_lookup(wanted: DataFrame, derived: DataFrame, key: str, field: str) -> DataFrame:
    """wanted (key) with `field` and `hit`: a field that was worked out before is a hit, also where it is null; derived holds
    (key, field, value) rows."""
    d = derived.where(F.col("field") == field).select(key, F.col("value").alias(field), F.lit(True).alias("hit"))
    return wanted.join(d, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def judged_metadata(metadata: DataFrame, trust: Callable[[str], str | None], as_of: Column) -> DataFrame:
    """metadata with `trusted`: by rule, and where that can't tell by what the judge says of the JSON, once for each distinct one."""
    from ..functions import recent_release, trust_rule
    from .model import judged

    rule = trust_rule(F.col("downloads"), F.col("repository").isNotNull(), F.size("versions"), F.col("readme"), recent_release(F.col("changelog"), as_of), F.col("dependents"))
    ask = metadata.withColumn("rule", rule).withColumn("__prompt", F.when(F.col("rule") == "ask", F.to_json(F.struct("readme", "description", "downloads", "dependents", F.size("versions").alias("versions")))))
    out = judged(ask, "__prompt", trust, "__answer")
    high = F.get_json_object("__answer", "$.trust_level") == "HIGH_TRUST"
    return out.withColumn("trusted", (F.col("rule") == "trusted") | ((F.col("rule") == "ask") & F.coalesce(high, F.lit(False)))).drop("__prompt", "__answer")


def tarball_texts(content: bytes) -> dict[str, str]:
    """path -> text of a package tarball's readme, manifest and declaration files, without the leading package/."""
    import io
    import tarfile

    out: dict[str, str] = {}
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
        for m in tar:
            path = m.name.replace("\\", "/").removeprefix("package/")
            if m.isfile() and (path.endswith(".d.ts") or path == "package.json" or path.rsplit(".", 1)[0].lower() == "readme"):
                out[path] = tar.extractfile(m).read().decode("utf-8", "replace")
    return out


def tarballs(files: DataFrame) -> DataFrame:
    """(path, readme, declarations: array of path and text, entry_types): of package tarballs (path, content), the readme, the declaration
    files with those that the manifest names first, and their paths; unreadable ones have nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    texts = tarball_texts(content)
                except Exception:  # not a tarball
                    rows.append((path, None, None, None))
                    continue
                readme = next((texts[p] for p in sorted(texts) if p.lower().startswith("readme")), None)
                first = declared_types(texts.get("package.json"))
                names = [*dict.fromkeys([*(p for p in first if p in texts), *(p for p in sorted(texts) if p.endswith(".d.ts"))])]
                rows.append((path, readme, [{"path": p, "text": texts[p]} for p in names], first))
            yield pd.DataFrame(rows, columns=["path", "readme", "declarations", "entry_types"])

    return files.select("path", "content").mapInPandas(run, "path string, readme string, declarations array<struct<path:string,text:string>>, entry_types array<string>")


def declared_types(manifest: str | None) -> list[str]:
    """Declaration files that a manifest names: types, typings, and each "types" within exports."""
    try:
        m = json.loads(manifest or "")
    except ValueError:
        return []
    found: list[str] = []

    def add(x) -> None:
        if isinstance(x, str):
            p = x.strip()
            while p.startswith("./"):
                p = p[2:]
            p = p.lstrip("/")
            if p.endswith(".d.ts") and p not in found:
                found.append(p)

    if isinstance(m, dict):
        add(m.get("types"))
        add(m.get("typings"))
        todo = [m.get("exports")]
        while todo:
            x = todo.pop(0)
            if isinstance(x, dict):
                for k, v in x.items():
                    add(v) if k == "types" and isinstance(v, str) else todo.append(v)
            elif isinstance(x, list):
                todo += x
    return found


def judged_behaviors(uses: DataFrame, metadata: DataFrame, judge: Callable[[str], str]) -> DataFrame:
    """(module, property, module_behavior, api_behavior): what the judge says of each module in use, by its readme and keywords, and of each
    of its calls, by what its declaration files say too. Equal questions are asked once; unknown is null.

    metadata (module, description, keywords, readme, declarations: array of path and text, types: array of paths).
    """
    from ..functions import declared_evidence, known
    from .model import judged, prompt

    j = uses.select("module", "property").distinct().join(metadata, "module")
    about = [F.col("module").alias("package_name"), F.col("description"), F.col("keywords"), F.col("readme")]
    j = j.withColumn("__m", prompt("module_functionality", F.to_json(F.struct(*about))))
    evidence = declared_evidence("declarations", "types", "property")
    j = j.withColumn("__a", prompt("api_behavior", F.to_json(F.struct(F.col("property").alias("method_name"), *about, evidence.alias("declaration_evidence")))))
    j = judged(judged(j, "__m", judge, "__ma"), "__a", judge, "__aa")
    return j.select("module", "property", known(F.get_json_object("__ma", "$.overall_functionality")).alias("module_behavior"), known(F.get_json_object("__aa", "$.api_behavior")).alias("api_behavior"))


def with_behaviors(metadata: DataFrame, said: DataFrame) -> DataFrame:
    """metadata (module, trusted) as enriched() takes it: module_behavior, and api_behavior as a map of properties."""
    s = said.groupBy("module").agg(F.max("module_behavior").alias("module_behavior"), F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("api_behavior").isNotNull(), F.struct("property", "api_behavior"))))).alias("api_behavior"))
    return metadata.join(s, "module", "left")
