"""python -m ligature.cli train | predict | prefilter | finalize | score | validate | char-grams"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import validation
from .plans import char_grams, linkage
from .sources import tables


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ligature")
    sub = out.add_subparsers(dest="command", required=True)
    train = sub.add_parser("train")
    train.add_argument("--data", required=True)
    train.add_argument("--models", required=True)
    train.add_argument("--entities", type=int, default=300_000)
    train.add_argument("--seed", type=int, default=42)
    train.add_argument("--rounds", type=int, default=60)
    for name in ("predict", "finalize"):
        p = sub.add_parser(name)
        for flag in ("--data", "--models", "--output"):
            p.add_argument(flag, required=True)
        p.add_argument("--split", default="test")
        p.add_argument("--holdout", action="store_true")
    sub.add_parser("prefilter").add_argument("--models", required=True)
    score = sub.add_parser("score")
    score.add_argument("--matches", required=True)
    score.add_argument("--truth", required=True)
    check = sub.add_parser("validate")
    check.add_argument("--matches", required=True)
    check.add_argument("--candidates")
    check.add_argument("--source1", required=True)
    check.add_argument("--targets", nargs="*", default=[])
    plain = sub.add_parser("char-grams")
    for flag in ("--data", "--output"):
        plain.add_argument(flag, required=True)
    for flag, usual in (("--k-name", 30), ("--k-full", 20), ("--most", 60), ("--folds", 5), ("--rounds", 60)):
        plain.add_argument(flag, type=int, default=usual)
    plain.add_argument("--all-countries", action="store_true")
    plain.add_argument("--train-only", action="store_true")
    return out


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("ligature").getOrCreate()
    if a.command == "validate":
        ids = [tables.read_ids(spark, p) for p in a.targets]
        targets = None
        for df in ids:
            targets = df if targets is None else targets.unionByName(df)
        report = validation.validate(spark, a.matches, tables.read_ids(spark, a.source1).select(F.col("id")), a.candidates, targets)
        for kind, lines in (("error", report.errors), ("warning", report.warnings)):
            for line in lines:
                print(f"{kind}: {line}")
        return report.exit_code
    if a.command == "train":
        out = linkage.train(spark, a.data, a.models, a.entities, a.seed, rounds=a.rounds)["decision"]
    elif a.command == "char-grams":
        out = char_grams.run(spark, a.data, a.output, a.k_name, a.k_full, a.most, not a.all_countries, a.folds, a.rounds, a.train_only)
    elif a.command == "prefilter":
        out = linkage.select_prefilter(spark, a.models)["prefilter_p1"]
    elif a.command == "score":
        out = linkage.score(spark, a.matches, a.truth)
    else:
        out = getattr(linkage, a.command)(spark, a.data, a.models, a.output, a.split, a.holdout)
    print(json.dumps(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
