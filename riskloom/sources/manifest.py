"""Sources discovered, selected and run in batches: all as DataFrames, one row per source.

A batch run is a plan (which stage of which source runs, is skipped or forced) and its records;
the stages themselves are functions that the caller gives.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import ids, web
from riskloom.operators.contracts import ACQUISITION, STAGES, tags
from riskloom.sources.readers import read_files, read_source_list

SIDECARS = [".metadata.json", ".meta.json"]


def extensions(wanted: list[str]) -> list[str]:
    """Extensions with a dot in lower case; the supported ones if none are wanted."""
    out = [e.strip().lower() for e in wanted]
    if any(not e.strip(".") for e in out):
        raise ValueError("an extension is empty")
    return sorted({e if e.startswith(".") else f".{e}" for e in out}) or sorted(web.SUPPORTED)


def glob_pattern(pattern: str) -> str:
    """A shell pattern as a regular expression for whole texts."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return f"(?s)^{out}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether the file's name or its whole path fits one of the shell patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | ids.base_name(path).rlike(glob_pattern(p)) | path.rlike(glob_pattern(p))
    return out


def is_sidecar(path: Column) -> Column:
    return F.lower(path).rlike(r"\.meta(data)?\.json$")


def is_source_file(path: Column, wanted: list[str]) -> Column:
    return ~is_sidecar(path) & ids.suffix(path).isin(extensions(wanted))


def merged(*parts: Column) -> Column:
    """Maps of texts made one: later values win unless they are empty."""
    kept = [F.map_filter(F.coalesce(p, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (v != "")) for p in parts]
    out = kept[0]
    for p in kept[1:]:
        out = F.map_concat(_without(out, p), p)
    return out


def _without(m: Column, other: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.map_contains_key(other, k))


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """files (path) with `metadata`: of the sidecars (path, content) of four spellings, the first that there is."""
    stem = F.regexp_replace("path", r"(?<=[^./])\.[^./]+$", "")
    names = [F.concat(base, F.lit(end)) for end in SIDECARS for base in (F.col("path"), stem)]
    wanted = files.select("path", F.posexplode(F.array(*names)).alias("rank", "sidecar"))
    found = wanted.join(sidecars.select(F.col("path").alias("sidecar"), "content"), "sidecar").groupBy("path").agg(F.min_by("content", "rank").alias("content"))
    return files.join(found, "path", "left").withColumn("metadata", F.from_json("content", "map<string,string>")).drop("content")


def discover(spark: SparkSession, folders: list[str], lists: list[str], wanted: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """source, origin, metadata of all files in folders that are sources, and all lines of source lists."""
    out = spark.createDataFrame([], "source string, origin string, metadata map<string,string>")
    for folder in folders:
        files = read_files(spark, folder)
        path = F.col("path")
        kept = files.filter(is_source_file(path, wanted or []) & ~excluded(path, exclude or [])).select("path")
        notes = files.filter(is_sidecar(path)).select("path", F.col("content").cast("string").alias("content"))
        out = out.unionByName(with_sidecars(kept, notes).select(path.alias("source"), F.lit(f"dir:{folder}").alias("origin"), "metadata"))
    for name in lists:
        lines = read_source_list(spark, name)
        out = out.unionByName(lines.select(F.col(lines.columns[0]).alias("source"), F.lit(f"sources_file:{name}").alias("origin"), F.lit(None).cast("map<string,string>").alias("metadata")))
    return out


def ingestible(include_blocked: bool = False, include_failed: bool = False) -> list[str]:
    """Acquisition statuses of sources that a manifest takes."""
    if include_failed:
        return ACQUISITION
    return ["not_acquired", "acquired", "cached", "manual"] + (["blocked", "paywalled"] if include_blocked else [])


def selected(rows: DataFrame, order: str, source_ids: list[str] | None = None, wanted: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of these sources with one of these tags; a limit takes the first by order."""
    sources, labels = [s for s in source_ids or [] if s.strip()], [t for t in wanted or [] if t.strip()]
    if sources:
        rows = rows.filter(F.col("source_id").isin(sources))
    if labels:
        rows = rows.filter(F.arrays_overlap(tags(F.col("tags")), F.array(*(F.lit(t) for t in labels))))
    return rows if limit is None else rows.orderBy(order).limit(limit)


def summary(discovered: DataFrame, registered: DataFrame, rows: DataFrame) -> DataFrame:
    """dimension, value, n: sources by origin and extension, registrations by status, manifest rows by kind and status, and what was left out.

    registered: source_id, status, duplicate_of, acquisition_status, last_status.
    """
    count = lambda df, name, c: df.groupBy(c.cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("dimension"), "value", "n")
    ext = F.when(web.is_url(F.col("source")), F.lit("url")).otherwise(F.coalesce(F.nullif(ids.suffix(F.col("source")), F.lit("")), F.lit("none")))
    out = registered.join(rows.select("source_id").distinct(), "source_id", "left_anti")
    why = F.array(
        F.when(F.col("duplicate_of").isNotNull(), F.lit("duplicate")),
        F.when(F.col("acquisition_status").isin("blocked", "paywalled", "not_found", "fetch_failed", "unsupported"), F.lit("acquisition")),
        F.when(F.col("last_status") == "failed", F.lit("pipeline")),
    )
    left = out.dropDuplicates(["source_id"]).select(F.explode(F.filter(why, lambda w: w.isNotNull())).alias("why"))
    parts = [
        count(discovered, "origin", F.substring_index("origin", ":", 1)), count(discovered, "extension", ext), count(registered, "registration", F.col("status")),
        count(rows, "kind", F.col("source_kind")), count(rows, "acquisition", F.col("acquisition_status")), count(left, "excluded", F.col("why")),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total


# ---------------------------------------------------------------- batch runs


def forced(stage: Column, force: bool, force_from: str | None) -> Column:
    """Whether a stage runs anew: all do, or those from a named one on."""
    if force or force_from is None:
        return F.lit(force)
    place = lambda c: F.array_position(F.array(*(F.lit(s) for s in STAGES)), c)
    return place(stage) >= F.lit(STAGES.index(force_from) + 1)


def plan_stages(sources: DataFrame, done: DataFrame, stages: list[str], resume: bool = True, force: bool = False, force_from: str | None = None) -> DataFrame:
    """source_id, place, stage, action (run or skip): a stage that succeeded and left its output is skipped on resume.

    done: source_id, stage, status, has_output; of several records of a stage any success counts.
    """
    every = sources.select("source_id").distinct().withColumn("s", F.explode(F.arrays_zip(F.array(*(F.lit(i) for i in range(len(stages)))).alias("place"), F.array(*(F.lit(s) for s in stages)).alias("stage")))).select("source_id", "s.place", "s.stage")
    good = done.filter((F.col("status") == "success") & F.col("has_output")).select("source_id", "stage").distinct().withColumn("good", F.lit(True))
    rows = every.join(good, ["source_id", "stage"], "left")
    skip = F.lit(resume) & F.coalesce("good", F.lit(False)) & ~forced(F.col("stage"), force, force_from)
    return rows.select("source_id", "place", "stage", F.when(skip, "skip").otherwise("run").alias("action"))


def run_batch(sources: DataFrame, done: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], resume: bool = True, force_from: str | None = None, save: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """source_id, stage, status of each stage: success, failed, skipped_cached, or blocked behind a failed one.

    A stage function takes the sources to run (source_id) and returns source_id and ok. Sources are
    independent: one that fails stops its own later stages and no other's. `save` keeps a stage's
    result (a checkpoint or a written table), so that no stage runs twice.
    """
    plan = plan_stages(sources, done, list(stages), resume, force_from=force_from)
    alive = sources.select("source_id").distinct()
    out = None
    for name, f in stages.items():
        todo = plan.filter((F.col("stage") == name) & (F.col("action") == "run")).select("source_id")
        run = alive.join(todo, "source_id", "left_semi")
        result = save(f(run).select("source_id", F.when(F.coalesce("ok", F.lit(False)), "success").otherwise("failed").alias("status")))
        skipped = alive.join(todo, "source_id", "left_anti").withColumn("status", F.lit("skipped_cached"))
        behind = sources.select("source_id").distinct().join(alive, "source_id", "left_anti").withColumn("status", F.lit("blocked"))
        rows = result.unionByName(skipped).unionByName(behind).withColumn("stage", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
        alive = result.unionByName(skipped).filter("status <> 'failed'").select("source_id")
    return out.select("source_id", "stage", "status")
