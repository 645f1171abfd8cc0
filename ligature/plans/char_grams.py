"""The character-gram plan: one stage, folds by entity, one rule with a one-to-one option."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, labels, metrics, models
from ..operators.char_grams import K_FULL, K_NAME, MOST, candidate_lists, plain_candidates, plain_records
from ..operators.plain_features import PLAIN_COLUMNS, plain_features
from ..sources import tables


def prepare(first: DataFrame, others: DataFrame, k_name: int = K_NAME, k_full: int = K_FULL, most: int = MOST, by_country: bool = True) -> DataFrame:
    """(s1, cand, PLAIN_COLUMNS) of raw records."""
    left, right = plain_records(first).persist(), plain_records(others).persist()
    return plain_features(plain_candidates(left, right, k_name, k_full, most, by_country), left, right)


def fit(pairs: DataFrame, truth: DataFrame, n_true: DataFrame, folds: int = 5, rounds: int = models.ROUNDS, **params) -> tuple[list, dict]:
    """The models of all folds and the rule that is best on their out-of-fold probabilities."""
    known = truth.select("s1", F.col("c").alias("c"))
    labelled = labels.labelled(pairs.withColumn("c", F.col("cand")), known).drop("c")
    folded = labelled.join(labels.group_folds(n_true.select(F.col("s1").alias("entity_id")), folds), "s1")
    scored, fitted = models.cross_validated(folded, PLAIN_COLUMNS, "p", folds, rounds, **params)
    best = decisions.best_of(decisions.plain_scores(scored.select("s1", "cand", "p", "label"), n_true)).first().asDict()
    return fitted, {k: best[k] for k in ("t", "alpha", "one_to_one", "macro_f05")}


def predict(fitted: list, rule: dict, pairs: DataFrame) -> DataFrame:
    """(s1, cands)."""
    scored = models.ensemble(fitted, pairs, PLAIN_COLUMNS)
    return decisions.plain_lists(decisions.decide_plain(scored.select("s1", "cand", "p"), rule["t"], rule["alpha"], rule["one_to_one"]))


def _split(spark: SparkSession, data: str, split: str) -> tuple[DataFrame, DataFrame]:
    first, *others = (tables.read_tsv(spark, f"{data}/{split}_source{i}.tsv", tables.RECORD) for i in (1, 2, 3))
    return first, reduce(DataFrame.unionByName, others)


def _ranked(lists: DataFrame, column: str) -> DataFrame:
    """(s1, c, rank) of lists."""
    return lists.select("s1", F.posexplode(column).alias("rank", "c"))


def run(
    spark: SparkSession,
    data: str,
    output: str,
    k_name: int = K_NAME,
    k_full: int = K_FULL,
    most: int = MOST,
    by_country: bool = True,
    folds: int = 5,
    rounds: int = models.ROUNDS,
    train_only: bool = False,
    **params,
) -> dict:
    """Fit on {data}/train_*.tsv and, unless train_only, write both id lists of {data}/test_*.tsv; returns the rule and what it reaches."""
    first, others = _split(spark, data, "train")
    pairs = prepare(first, others, k_name, k_full, most, by_country)
    pairs.write.mode("overwrite").parquet(f"{output}/train_pairs")
    pairs = spark.read.parquet(f"{output}/train_pairs")
    truth = tables.exploded_truth(tables.read_id_lists(spark, f"{data}/train_ground_truth.tsv"))
    n_true = labels.true_counts(first, truth)
    fitted, rule = fit(pairs, truth, n_true, folds, rounds, **params)
    labelled = labels.labelled(pairs.withColumn("c", F.col("cand")), truth)
    found = metrics.retrieval_recall(labelled, n_true).first().asDict()
    report = {"rule": rule, "retrieval": found, "countries": {r["country"]: r["count"] for r in first.groupBy("country").count().collect()}}
    tables.write_json(spark, f"{output}/report", report)
    if not train_only:
        first, others = _split(spark, data, "test")
        pairs = prepare(first, others, k_name, k_full, most, by_country)
        entities = first.select("entity_id").withColumn("ordinal", F.monotonically_increasing_id())
        tables.write_id_lists(entities, _ranked(predict(fitted, rule, pairs), "cands"), f"{output}/matching_results.tsv", "matched_entity_ids", distinct=True)
        tables.write_id_lists(entities, _ranked(candidate_lists(pairs), "cands"), f"{output}/candidate_pairs.tsv", "candidate_entity_ids", distinct=True)
    return report
