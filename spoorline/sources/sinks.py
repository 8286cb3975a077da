"""Reports and caches as tables."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(reports: DataFrame, path: str) -> None:
    """A JSON object a package, without null fields."""
    reports.write.mode("overwrite").json(path)


def append_steps(steps: DataFrame, path: str, by: str = "stage") -> None:
    """Analysis steps are only added, in a folder for each stage."""
    steps.write.mode("append").partitionBy(by).parquet(path)


def write_by_entry(rows: DataFrame, path: str, payload: str = "payload") -> None:
    """Rows that have a payload, in a folder for each entry."""
    rows.where(F.col(payload).isNotNull()).write.mode("overwrite").partitionBy("entry").json(path)


def looked_up(wanted: DataFrame, cache: DataFrame, key: str, payload: str) -> DataFrame:
    """wanted with payload and state: hit, tombstone (a row that says there is nothing) or miss."""
    c = cache.select(key, payload, F.lit(True).alias("__there"))
    return wanted.join(c, key, "left").withColumn("state", F.when(F.col("__there").isNull(), "miss").when(F.col(payload).isNull(), "tombstone").otherwise("hit")).drop("__there")


def upserted(cache: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """cache with the rows of changes in place of those of the same key."""
    return cache.join(changes, key, "left_anti").unionByName(changes)


def derived(cache: DataFrame, changes: DataFrame, key: str, maps: list[str]) -> DataFrame:
    """Fields of changes that aren't null over those of the same key; maps are merged, the later value winning. A key that the
    cache doesn't have is left out."""
    cols = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in cols])

    def field(c: str):
        if c not in maps:
            return F.coalesce(f"__{c}", c)
        both = F.map_concat(F.map_filter(c, lambda k, _: ~F.coalesce(F.map_contains_key(f"__{c}", k), F.lit(False))), f"__{c}")
        return F.when(F.col(f"__{c}").isNull(), F.col(c)).when(F.col(c).isNull(), F.col(f"__{c}")).otherwise(both)

    return cache.join(new, key, "left").select(*[field(c).alias(c) if c in cols else c for c in cache.columns])


def invalidated(cache: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return cache.join(keys, key, "left_anti")


def overwrite(df: DataFrame, path: str) -> DataFrame:
    """Write a new version beside the old ones, then point to it: the pointer is one small file, put in place by a rename, so that
    readers see the old version or the new one, and a crash between leaves the old one. Versions but the last two are deleted."""
    spark: SparkSession = df.sparkSession
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    base = path.rstrip("/")
    df.write.parquet(f"{base}/{version}")
    fs, at = _files(spark, base)
    fresh = at(f"{base}/_current.{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    current = at(f"{base}/_current")
    if not fs.rename(fresh, current):  # some file systems don't rename over a file
        fs.delete(current, False)
        if not fs.rename(fresh, current):
            raise OSError(f"{base}: the new version could not be put in place")
    for old in _versions(spark, base)[:-2]:
        fs.delete(at(f"{base}/{old}"), True)
    return spark.read.parquet(f"{base}/{version}")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version of a table written by overwrite() that its pointer names; where a crash left none, the last complete one."""
    base = path.rstrip("/")
    fs, at = _files(spark, base)
    if fs.exists(at(f"{base}/_current")):
        stream = fs.open(at(f"{base}/_current"))
        version = bytes(stream.readAllBytes()).decode()
        stream.close()
    else:
        version = next(v for v in reversed(_versions(spark, base)) if fs.exists(at(f"{base}/{v}/_SUCCESS")))
    return spark.read.parquet(f"{base}/{version}")


def _files(spark: SparkSession, base: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _versions(spark: SparkSession, base: str) -> list[str]:
    fs, at = _files(spark, base)
    return sorted(s.getPath().getName() for s in fs.listStatus(at(base)) if s.isDirectory())


def write_programs(programs: DataFrame, edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """Merged function graphs as three tables."""
    for name, t in (("programs", programs), ("edges", edges), ("nodes", nodes)):
        t.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def report_rows(reports: DataFrame) -> DataFrame:
    """Reports as JSON texts, without null fields."""
    return reports.select("package_name", F.to_json(F.struct(*reports.columns)).alias("report"))


@dataclass(frozen=True)
class CacheOptions:
    """Where the metadata cache is, and whether it is used."""

    folder: str
    enabled: bool = True

    @staticmethod
    def of(spark: SparkSession, default: str) -> CacheOptions:
        """From spark.spoorline.cache.folder and spark.spoorline.cache.enabled."""
        return CacheOptions(spark.conf.get("spark.spoorline.cache.folder", default), spark.conf.get("spark.spoorline.cache.enabled", "true").lower() == "true")
