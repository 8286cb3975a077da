"""Where in a package the malicious code is: what a judge is shown, and which of its answers hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import Judge, judged, prompt
from .verdict import said

#: Fields of a judgement that a judge of places is shown: fixed names.
SHOWN = ("judgement", "explanation", "reason", "key_evidence", "cross_component_evidence", "node_to_be_checked")


def relevant_components(components: DataFrame, by: list[str]) -> DataFrame:
    """The components judged malicious; of an entry without any, all."""
    w = Window.partitionBy(*by)
    bad = F.coalesce(F.col("judgement") == "malicious", F.lit(False))
    return components.withColumn("__any", F.max(bad).over(w)).where(bad | ~F.col("__any")).drop("__any")


def slice_texts(slices: DataFrame, by: list[str]) -> DataFrame:
    """(by, file, text): the code of all slices (by, component, file, code: lines) of a file, in order of the components."""
    line = F.struct("component", F.array_join("code", "\n").alias("text"))
    return slices.where("code IS NOT NULL").groupBy(*by, "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), "\n").alias("text"))


def synthesis_view(reports: DataFrame, by: list[str]) -> DataFrame:
    """Reports with the fields that the judge is shown, as far as they have them."""
    return reports.select(*by, *[c for c in SHOWN if c in reports.columns])


def component_view(components: DataFrame, by: list[str]) -> DataFrame:
    """(by, component, judgement, explanation, key_evidence, sliced_code); the reason stands in for an empty explanation."""
    return components.select(*by, "component", "judgement", F.nullif(said(F.col("explanation"), F.col("reason")), F.lit("")).alias("explanation"), "key_evidence", "sliced_code")


def relevant_files(files: DataFrame, entries: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """Of the files (by, file, text) that an entry's (by, file) reading served, the entry's own and those that evidence (by, file) cites."""
    wanted = entries.select(*by, "file").unionByName(evidence.where("file IS NOT NULL").select(*by, "file")).distinct()
    return files.join(wanted, [*by, "file"], "left_semi")


def clean_evidence(evidence: Column) -> Column:
    """Claims and files of evidence; items with neither are left out."""
    own = F.transform(evidence, lambda e: F.struct(e["claim"].alias("claim"), e["file"].alias("file")))
    return F.coalesce(F.filter(own, lambda e: e["claim"].isNotNull() | e["file"].isNotNull()), F.array().cast("array<struct<claim:string,file:string>>"))


def validated(answers: DataFrame, allowed: DataFrame, by: list[str]) -> DataFrame:
    """answers (by, summary, locations: array of struct(file, code, reason)) -> the same with the locations in allowed files (by,
    file) whose code isn't blank, in their order; answers without any such location are left out."""
    each = answers.select(*by, F.posexplode("locations").alias("__p", "l")).where("l.file IS NOT NULL AND l.code IS NOT NULL AND trim(l.code) <> ''").withColumn("file", F.col("l.file"))
    kept = each.join(allowed.select(*by, "file").distinct(), [*by, "file"], "left_semi")
    one = F.struct("__p", F.struct("l.file", "l.code", F.coalesce("l.reason", F.lit("")).alias("reason")).alias("l"))
    found = kept.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["l"]).alias("locations"))
    return answers.select(*by, F.coalesce("summary", F.lit("")).alias("summary")).join(found, by)


def payload(package: Column, entry: Column, synthesis: Column, components: Column) -> Column:
    """What the judge of places is asked, as JSON."""
    return F.to_json(F.struct(package.alias("package"), entry.alias("entry"), synthesis.alias("synthesis"), components.alias("components")))


ANSWER = "summary string, locations array<struct<file:string,code:string,reason:string>>"


def localized(components: DataFrame, reports: DataFrame, slices: DataFrame, by: list[str], judge: Judge) -> DataFrame:
    """(by, summary, locations): the places that the judge names, in files that it was shown. components (by, component, judgement, explanation, reason,
    key_evidence, sliced_code), reports (by and what synthesis_view() shows), slices (by, component, file, code)."""
    rel = relevant_components(components, by)
    shown = component_view(rel, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("component", "judgement", "explanation", "key_evidence", "sliced_code"))).alias("components"))
    view = [c for c in synthesis_view(reports, by).columns if c not in by]
    j = shown.join(synthesis_view(reports, by), by, "left")
    asked = j.select(*by, prompt("locate", F.to_json(F.struct(F.struct(*view).alias("synthesis"), "components"))).alias("__p"))
    texts = slice_texts(slices.join(rel.select(*by, "component"), [*by, "component"], "left_semi"), by)
    return _answers(asked, texts, by, judge)


def localized_in_files(entries: DataFrame, files: DataFrame, evidence: DataFrame, by: list[str], judge: Judge) -> DataFrame:
    """The same for entries (by, file, reason) that were judged by their files: those served (by, file, text) that are the entry's or cited."""
    texts = relevant_files(files, entries, evidence, by)
    shown = texts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "text")))).alias("files"))
    cited = evidence.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("claim", "file"))).alias("key_evidence"))
    j = entries.join(shown, by).join(cited, by, "left")
    asked = j.select(*by, prompt("locate_in_files", F.to_json(F.struct(F.col("file").alias("entry"), "reason", "key_evidence", "files"))).alias("__p"))
    return _answers(asked, texts, by, judge)


def _answers(asked: DataFrame, texts: DataFrame, by: list[str], judge: Judge) -> DataFrame:
    out = judged(asked, "__p", judge, "__a").where("__a IS NOT NULL").withColumn("__a", F.from_json("__a", ANSWER))
    return validated(out.select(*by, "__a.summary", "__a.locations"), texts, by)
