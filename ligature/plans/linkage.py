"""The linkage workloads: train, predict, choose a prefilter, decide again, score. Folders hold Parquet, models and JSON; any file system
that Spark reaches will do. Pairs and scores carry real ids, so nothing depends on the order of rows in a file."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import held_out
from ..operators import decisions, labels, metrics, models
from ..operators.pair_features import FEATURE_COLUMNS, STAGE2_COLUMNS, group_features, pair_features
from ..operators.retrieval import DF_CAP, TOP_K, retrieve
from ..sources import tables
from ..sources.staging import staged

TEXTS = ["c_name_core", "c_addr_norm", "c_addr_nums"]


def stage_one(queries: DataFrame, corpus: DataFrame, blocking: dict) -> DataFrame:
    """Retrieved pairs with FEATURE_COLUMNS."""
    return pair_features(retrieve(queries, corpus, **blocking), queries, corpus)


def stage_two(scored: DataFrame) -> DataFrame:
    """Rows with p1 and all else that a decision needs, with STAGE2_COLUMNS; group features see all retrieved pairs."""
    others = [c for c in scored.columns if c not in STAGE2_COLUMNS and c not in ("s1", "c", *TEXTS)]
    keys = scored.select(F.col("s1").alias("_s1"), F.col("c").alias("_c"), *others)
    grouped = group_features(scored)
    if not others:
        return grouped
    return grouped.join(keys, (F.col("s1") == F.col("_s1")) & (F.col("c") == F.col("_c"))).drop("_s1", "_c")


def train(
    spark: SparkSession,
    data: str,
    model_dir: str,
    n_entities: int = 300_000,
    seed: int = 42,
    top_k: int = TOP_K,
    df_cap: int = DF_CAP,
    rounds: int = models.ROUNDS,
    **params,
) -> dict:
    """Both stages and the decision rule from {data}/train_*.tsv; returns and writes the config."""
    blocking = {"top_k": top_k, "df_cap": df_cap}
    corpus = staged(tables.load_corpus(spark, data, "train"), "corpus")
    raw = labels.sampled_entities(tables.read_tsv(spark, f"{data}/train_source1.tsv", tables.RECORD), n_entities, seed)
    queries = tables.prepare_records(raw).persist()
    truth = labels.truth_of(tables.exploded_truth(tables.read_id_lists(spark, f"{data}/train_ground_truth.tsv")), queries).persist()
    n_true = labels.true_counts(queries, truth).persist()
    parts = labels.split_entities(queries, seed)
    pairs = labels.labelled(stage_one(queries, corpus, blocking), truth).join(parts, "s1")
    pairs.write.mode("overwrite").parquet(f"{model_dir}/pairs")
    pairs = spark.read.parquet(f"{model_dir}/pairs")
    recall = metrics.retrieval_recall(pairs, n_true).first().asDict()

    scored, first = models.out_of_fold(pairs, FEATURE_COLUMNS, "p1", rounds, **params)
    scored.write.mode("overwrite").parquet(f"{model_dir}/stage1_scores")
    grouped = stage_two(spark.read.parquet(f"{model_dir}/stage1_scores"))
    second = models.fit(grouped.where("role = 'fit'"), grouped.where("role = 'tune'"), STAGE2_COLUMNS, rounds, **params)
    held = models.predict(second, grouped.where("role <> 'fit'"), STAGE2_COLUMNS, "p2").select("s1", "c", "blk_rank", "role", "label", "p1", "p2")
    tables.write_scores(held, f"{model_dir}/held_out_scores")
    n_true.join(parts, "s1").write.mode("overwrite").parquet(f"{model_dir}/held_out_entities")
    first.write().overwrite().save(f"{model_dir}/stage1")
    second.write().overwrite().save(f"{model_dir}/stage2")

    rules = tuned_rules(spark, model_dir)
    chosen = decisions.select_rule(rules)
    config = {
        "blocking": blocking,
        "features": {"stage1": FEATURE_COLUMNS, "stage2": STAGE2_COLUMNS},
        "retrieval": recall,
        "rules": rules,
        "decision": chosen,
        "importance": {"stage1": models.importances(first, FEATURE_COLUMNS), "stage2": models.importances(second, STAGE2_COLUMNS)},
    }
    tables.write_json(spark, f"{model_dir}/config", config)
    for df in (queries, truth, n_true):
        df.unpersist()
    return select_prefilter(spark, model_dir)


def _held_out(spark: SparkSession, model_dir: str, role: str) -> tuple[DataFrame, DataFrame]:
    pairs = spark.read.parquet(f"{model_dir}/held_out_scores").where(F.col("role") == role)
    return pairs, spark.read.parquet(f"{model_dir}/held_out_entities").where(F.col("role") == role).select("s1", "n_true")


def tuned_rules(spark: SparkSession, model_dir: str) -> list[dict]:
    """The best rule of each kind for each stage on the tuning entities, with its score on the reported ones."""
    rules = []
    tune, n_tune = _held_out(spark, model_dir, "tune")
    report, n_report = _held_out(spark, model_dir, "report")
    for stage in (1, 2):
        own = tune.withColumn("p", F.col(f"p{stage}"))
        best = decisions.best_of(decisions.threshold_scores(own, n_tune)).first()
        rules.append({"stage": stage, "type": "threshold", "t_all": best["t_all"], "t_top": best["t_top"], "tune_f05": best["macro_f05"]})
        best = decisions.best_of(decisions.expected_f_scores(own, n_tune)).first()
        rules.append({"stage": stage, "type": "expected_f", "c_missing": best["c_missing"], "s_empty": best["s_empty"], "tune_f05": best["macro_f05"]})
    for rule in rules:
        decided = decisions.apply_rule(report.withColumn("p", F.col(f"p{rule['stage']}")), rule)
        rule["report_f05"] = metrics.macro_f05(decided, n_report).first()["macro_f05"]
    return rules


def select_prefilter(spark: SparkSession, model_dir: str) -> dict:
    """The config with prefilter_p1: the greatest cutoff that costs nothing on the tuning entities; 0 if the second stage isn't used."""
    config = tables.read_json(spark, f"{model_dir}/config")
    rule = config["decision"]
    config["prefilter_p1"] = 0.0
    if rule["stage"] == 2:
        found = {}
        for role in ("tune", "report"):
            pairs, n_true = _held_out(spark, model_dir, role)
            found[role] = decisions.prefilter_table(pairs.withColumn("p", F.col("p2")), n_true, rule).orderBy("grid").collect()
        table = spark.createDataFrame(found["tune"])
        config["prefilter_p1"] = decisions.choose_prefilter(table).first()["p1_cutoff"]
        config["prefilter"] = {role: [r.asDict() for r in rows] for role, rows in found.items()}
    tables.write_json(spark, f"{model_dir}/config", config)
    return config


def scored_pairs(queries: DataFrame, corpus: DataFrame, config: dict, first: PipelineModel, second: PipelineModel) -> DataFrame:
    """(s1, c, blk_rank, p1, p2): p1 of all retrieved pairs, p2 of those that pass the prefilter, null for the rest."""
    scored = models.predict(first, stage_one(queries, corpus, config["blocking"]), FEATURE_COLUMNS, "p1")
    grouped = staged(stage_two(scored), "grouped")
    cutoff = config.get("prefilter_p1", 0.0)
    passed = models.predict(second, grouped.where(F.col("p1") >= cutoff), STAGE2_COLUMNS, "p2").select("s1", "c", "blk_rank", "p1", "p2")
    rest = grouped.where(F.col("p1") < cutoff).select("s1", "c", "blk_rank", "p1", F.lit(None).cast("double").alias("p2"))
    return passed.unionByName(rest)


def decide(scores: DataFrame, config: dict) -> DataFrame:
    """Surviving pairs with pred; the top candidate is that among the survivors."""
    rule = config["decision"]
    kept = scores.where(F.col("p1") >= config.get("prefilter_p1", 0.0))
    return decisions.apply_rule(kept.withColumn("p", F.col(f"p{rule['stage']}")), rule)


def decide_and_write(entities: DataFrame, scores: DataFrame, config: dict, output: str) -> dict:
    """Both id-list tables, and counts."""
    decided = decide(scores, config).withColumn("rank", F.col("blk_rank"))
    matches = decided.where("pred")
    tables.write_id_lists(entities, matches, f"{output}/matching_results.tsv", "matched_entity_ids")
    tables.write_id_lists(entities, decided, f"{output}/candidate_pairs.tsv", "candidate_entity_ids")
    counts = decided.agg(F.count("*").alias("candidate_pairs"), F.count_distinct("s1").alias("with_candidate"), F.count_if("pred").alias("matched_pairs"), F.count_distinct(F.when(F.col("pred"), F.col("s1"))).alias("with_match")).first().asDict()
    n = entities.count()
    return counts | {"entities": n, "without_candidate": n - counts["with_candidate"], "without_match": n - counts["with_match"]}


def _name(split: str, holdout: bool) -> str:
    return f"{split}_holdout_scores" if holdout else f"{split}_scores"


def _entities(spark: SparkSession, data: str, split: str, holdout: bool) -> DataFrame:
    raw = tables.read_tsv(spark, f"{data}/{split}_source1.tsv", tables.RECORD)
    return raw.where(held_out(F.col("entity_id"))) if holdout else raw


def predict(spark: SparkSession, data: str, model_dir: str, output: str, split: str = "test", holdout: bool = False) -> dict:
    config = tables.read_json(spark, f"{model_dir}/config")
    first, second = (PipelineModel.load(f"{model_dir}/stage{i}") for i in (1, 2))
    raw = _entities(spark, data, split, holdout)
    queries, corpus = staged(tables.prepare_records(raw), "queries"), staged(tables.load_corpus(spark, data, split), "corpus")
    tables.write_scores(scored_pairs(queries, corpus, config, first, second), f"{output}/{_name(split, holdout)}")
    return finalize(spark, data, model_dir, output, split, holdout)


def finalize(spark: SparkSession, data: str, model_dir: str, output: str, split: str = "test", holdout: bool = False) -> dict:
    """Decide again from the written scores."""
    config = tables.read_json(spark, f"{model_dir}/config")
    entities = _entities(spark, data, split, holdout).select("entity_id").withColumn("ordinal", F.monotonically_increasing_id())
    return decide_and_write(entities, spark.read.parquet(f"{output}/{_name(split, holdout)}"), config, output)


def score(spark: SparkSession, matches: str, truth: str) -> dict:
    predicted, known = tables.read_id_lists(spark, matches), tables.read_id_lists(spark, truth)
    missing = [r["s1"] for r in metrics.unknown_entities(predicted, known).limit(3).collect()]
    if missing:
        raise ValueError(f"entities without a truth, such as {', '.join(missing)}")
    return metrics.score_lists(predicted, known).first().asDict()
