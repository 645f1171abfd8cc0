"""Findings in id-list files: what a submission of matches and candidates must hold to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLES = 5


def examples(ids: DataFrame, column: str) -> DataFrame:
    """One row of the number of ids and the first few in order."""
    return ids.agg(F.count("*").alias("total"), F.coalesce(F.slice(F.array_sort(F.collect_set(column)), 1, EXAMPLES), F.array().cast("array<string>")).alias("examples"))


def listed(lists: DataFrame) -> DataFrame:
    """(s1, id, n): each id of lists (s1, ids as a comma list), as it is written, with how often it stands there. A blank list has none."""
    parts = lists.where("trim(ids) <> ''").select("s1", F.explode(F.split("ids", ",")).alias("id"))
    return parts.groupBy("s1", "id").agg(F.count("*").alias("n"))


def duplicate_entities(lists: DataFrame) -> DataFrame:
    return lists.groupBy("s1").agg(F.count("*").alias("n")).where("n > 1").select("s1")


def repeated_ids(lists: DataFrame) -> DataFrame:
    """(s1, id) where a row has an id more than once."""
    return listed(lists.select(F.struct("s1", F.monotonically_increasing_id().alias("row")).alias("s1"), "ids")).where("n > 1").select("s1.s1", "id").distinct()


def self_matches(lists: DataFrame) -> DataFrame:
    return listed(lists).where(F.col("id").startswith("S1-")).select("s1", "id")


def foreign_ids(lists: DataFrame) -> DataFrame:
    return listed(lists).where(~F.col("id").rlike("^S[123]-")).select("s1", "id")


def unknown_ids(lists: DataFrame, targets: DataFrame) -> DataFrame:
    """(s1, id) of ids that no target (id) has."""
    found = listed(lists).where(F.col("id").rlike("^S[23]-"))
    return found.join(targets.select("id"), "id", "left_anti").select("s1", "id")


def missing_entities(lists: DataFrame, required: DataFrame) -> DataFrame:
    return required.select(F.col("id").alias("s1")).distinct().join(lists.select("s1"), "s1", "left_anti")


def extra_entities(lists: DataFrame, required: DataFrame) -> DataFrame:
    return lists.select("s1").distinct().join(required.select(F.col("id").alias("s1")), "s1", "left_anti")


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(s1, id) of matches that are no candidates."""
    return listed(matches).select("s1", "id").join(listed(candidates).select("s1", "id"), ["s1", "id"], "left_anti")


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def exit_code(self) -> int:
        return 1 if self.errors else 0


def _told(found: DataFrame, column: str, what: str, into: list[str]) -> None:
    row = examples(found, column).first()
    if row["total"]:
        into.append(f"{what}: {row['total']}, such as {', '.join(row['examples'])}")


def read_lists(spark: SparkSession, path: str, column: str, report: Report) -> DataFrame | None:
    """(s1, ids) of a file, or None where it is not one to be read; rows without a tab are errors, blank ones pass."""
    try:
        lines = spark.read.text(path)
        head = lines.first()
    except Exception as error:  # the reader's own kinds of failure, told to the user as they are
        report.errors.append(f"{path} can't be read: {str(error).splitlines()[0]}")
        return None
    if head is None or not head["value"].strip():
        report.errors.append(f"{path} is empty")
        return None
    header = [x.strip().lower() for x in head["value"].lstrip("﻿").split("\t")]
    if header != ["source1_entity_id", column]:
        kind = "is separated by commas, not tabs" if len(header) == 1 and "," in head["value"] else f"has the header {header}"
        report.errors.append(f"{path} {kind}; source1_entity_id and {column} are to be there")
        return None
    body = lines.where((F.trim("value") != "") & (F.col("value") != head["value"]))
    _told(body.where(~F.contains("value", F.lit("\t"))), "value", f"{path}: rows without a tab", report.errors)
    parts = F.split("value", "\t")
    rest = F.expr("substring(value, instr(value, '\t') + 1)")
    return body.where(F.contains("value", F.lit("\t"))).select(parts[0].alias("s1"), rest.alias("ids"))


def check_lists(lists: DataFrame, required: DataFrame, targets: DataFrame | None, name: str, report: Report) -> None:
    _told(duplicate_entities(lists), "s1", f"{name}: entities with several rows", report.errors)
    _told(repeated_ids(lists), "s1", f"{name}: entities with an id more than once", report.errors)
    _told(self_matches(lists), "s1", f"{name}: entities matched to the first source", report.errors)
    _told(foreign_ids(lists), "id", f"{name}: ids of no source", report.errors)
    if targets is not None:
        _told(unknown_ids(lists, targets), "id", f"{name}: ids that are in no target file", report.errors)
    _told(missing_entities(lists, required), "s1", f"{name}: entities without a row", report.errors)
    _told(extra_entities(lists, required), "s1", f"{name}: entities that are not asked for", report.errors)


def validate(spark: SparkSession, matches: str, required: DataFrame, candidates: str | None = None, targets: DataFrame | None = None) -> Report:
    """Findings of a matching file and, if there is one, a candidate file; matches outside the candidates are a warning."""
    report = Report()
    found = read_lists(spark, matches, "matched_entity_ids", report)
    if found is not None:
        check_lists(found, required, targets, "matches", report)
    if candidates is None:
        report.warnings.append("no candidate file: it was not checked")
        return report
    offered = read_lists(spark, candidates, "candidate_entity_ids", report)
    if offered is not None:
        check_lists(offered, required, targets, "candidates", report)
        if found is not None:
            _told(outside_candidates(found, offered), "s1", "matches that are no candidates", report.warnings)
    return report
