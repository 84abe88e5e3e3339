"""Provenance: gates, correction totals, requests and their recordings, integrity of histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import json_string


def gate(checks: Column) -> Column:
    """A gate passes when all of its checks do."""
    return F.struct(F.forall(checks, lambda c: c["passed"]).alias("passed"), checks.alias("checks"))


def correction_violations(corrections: DataFrame) -> DataFrame:
    """Segment totals that do not add up."""
    return corrections.where("segments_total <> fixed + unchanged + unmatched + skipped OR unmatched_with_digits > unmatched")


def request_fingerprint(task: Column, image: Column, anchor: Column, hints: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the request's sorted JSON; ids take no part, hints count as a sorted list."""
    hint = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(hints), json_string), ","), F.lit("]"))
    body = F.concat(F.lit("{"), F.when(anchor.isNotNull(), F.concat(F.lit('"anchor_sha256":'), json_string(anchor), F.lit(","))).otherwise(""), F.lit('"image_sha256":'), json_string(image), F.lit(',"language_hints":'), hint, F.lit(',"task":'), json_string(task), F.lit("}"))
    return F.substring(F.sha2(body, 256), 1, 32)


def replay(requests: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their recorded results, and the misses.  A fingerprint recorded twice is an error."""
    twice = recordings.groupBy("fingerprint").count().where("count > 1")
    if (bad := twice.first()) is not None:
        raise ValueError(f"recorded twice: {bad['fingerprint']}")
    return requests.join(recordings, "fingerprint"), requests.join(recordings.select("fingerprint"), "fingerprint", "left_anti")


def history_violations(regions: DataFrame) -> DataFrame:
    """Regions whose record contradicts itself: region_id, problem.

    regions: document_id, version, region_id, chosen, fallback_reason,
    gate_passed, attempts (layer, failed).
    """
    key = ["document_id", "version", "region_id"]
    twice = regions.groupBy(key).count().where("count > 1").select(*key, F.lit("repeated").alias("problem"))
    clean = F.exists("attempts", lambda a: (a["layer"] == F.col("chosen")) & ~a["failed"])
    problems = F.array_compact(
        F.array(
            F.when(~clean, "no clean attempt of the chosen layer"),
            F.when((F.col("chosen") != "det") & ~F.coalesce("gate_passed", F.lit(False)), "gate not passed"),
            F.when((F.col("chosen") != "det") & F.col("fallback_reason").isNotNull(), "reason without fallback"),
        )
    )
    return regions.select(*key, F.explode(problems).alias("problem")).union(twice)
