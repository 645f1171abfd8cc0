import math
import os
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ligature import oracle, queries
from ligature.operators import char_grams, decisions, labels, metrics, pair_features, plain_features, retrieval
from ligature.sources import staging

SF = "/root/testdata/sf0.001"


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


PREPARED = "entity_id string, country string, name_core string, addr_norm string, addr_nums string, addr_first_num long, name_ntok short, name_non_ascii float"


def record(i, name, address="", country="x"):
    return (i, country, name, address, "", -1, len(name.split()), 0.0)


def test_weights_and_cap(spark):
    corpus = frame(spark, [record("S2-1", "aa"), record("S2-2", "aa"), record("S2-3", "bb"), record("S3-4", "")], PREPARED)
    assert {r.key: (r.df, round(r.idf, 6)) for r in retrieval.key_weights(corpus, 2).collect()} == {"n:aa": (2, round(math.log(3), 6)), "n:bb": (1, round(math.log(5), 6))}
    assert {r.key for r in retrieval.key_weights(corpus, 1).collect()} == {"n:bb"}


def test_retrieval_invariants(spark):
    queries_, corpus = queries.prepared(spark, SF)
    pairs = retrieval.retrieve(queries_, corpus, 5, 100).collect()
    by = {}
    for r in pairs:
        assert math.isclose(r.blk_name + r.blk_addr, r.blk_score, abs_tol=1e-9) and r.s1[:2] == "S1" and r.c[:2] != "S1"
        by.setdefault(r.s1, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.blk_rank)
        assert [r.blk_rank for r in own] == list(range(len(own))) and len(own) <= 5
        assert [(-round(r.blk_score, 6), r.c) for r in own] == sorted((-round(r.blk_score, 6), r.c) for r in own)
    assert retrieval.retrieve(queries_, corpus.limit(0)).count() == 0


def test_ties_go_by_id_and_countries_stay_apart(spark):
    corpus = frame(spark, [record("S2-a", "aa"), record("S2-b", "aa"), record("S3-c", "aa bb"), record("S3-d", "aa", country="y")], PREPARED)
    asked = frame(spark, [record("S1-1", "aa bb"), record("S1-2", "zz"), record("S1-3", "aa", country="z")], PREPARED)
    got = retrieval.retrieve(asked, corpus, 2).orderBy("s1", "blk_rank").collect()
    assert [(r.s1, r.c, r.blk_rank) for r in got] == [("S1-1", "S3-c", 0), ("S1-1", "S2-a", 1)]


def test_reference_candidate(spark):
    rows = [("q", "a", 0, False, 0.9), ("q", "b", 1, True, 0.6), ("q", "c", 2, False, 0.1), ("p", "d", 0, True, 0.4), ("t", "e", 0, True, 0.5), ("t", "f", 1, True, 0.5)]
    scored = frame(spark, [(s, c, r, float(s3), p, f"{c} name", c, c) for s, c, r, s3, p in rows], "s1 string, c string, blk_rank int, c_is_s3 double, p1 double, c_name_core string, c_addr_norm string, c_addr_nums string")
    got = {r.c: r for r in pair_features.with_reference(scored).collect()}
    a, c, d = got["a"], got["c"], got["d"]
    assert (a.p1_max_other, round(a.p1_sum_other, 6), a.n_p1_05, round(a.same_src_p1_sum_other, 6), a.ref_same_src) == (0.6, 0.7, 2, 0.1, 0.0)
    assert (c.p1_rank, c.p1_gap, c.ref_p1, c.ref_addr_norm, c.ref_same_src) == (2, 0.8, 0.9, "a", 1.0)
    assert (d.p1_max_other, d.ref_p1, d.ref_same_src) == (0.0, None, None)
    assert (got["e"].p1_rank, got["f"].p1_rank) == (0, 1)
    for k in pair_features.FEATURE_COLUMNS:
        if k not in ("blk_rank", "c_is_s3"):
            scored = scored.withColumn(k, F.lit(0.0))
    wide = {r.c: r for r in pair_features.group_features(scored).collect()}
    assert wide["d"].ref_name_token_set is None and wide["a"].ref_addr_token_set == 0.0 and wide["a"].ref_name_token_set > 0


def test_features_have_all_columns(spark):
    pairs, q, c = queries.candidates(spark, SF)
    few = pairs.where("blk_rank < 2")
    out = pair_features.pair_features(few, q, c)
    assert [x for x in out.columns if x in pair_features.FEATURE_COLUMNS] == pair_features.FEATURE_COLUMNS
    assert out.where(" or ".join(f"{k} is null" for k in pair_features.FEATURE_COLUMNS)).count() == 0
    assert out.agg(F.max("n_cands")).first()[0] == 2


# --- decisions and metrics

PAIRS = "s1 string, c string, blk_rank int, p double, label boolean"


def many(spark, seed=3):
    draw = random.Random(seed)
    rows = [(f"q{i}", f"c{draw.randrange(40)}-{j}", j, round(draw.random(), 2), draw.random() < 0.4) for i in range(25) for j in range(draw.randrange(6))]
    n_true = [(f"q{i}", sum(r[4] for r in rows if r[0] == f"q{i}") + draw.randrange(2)) for i in range(27)]
    return rows, n_true, frame(spark, rows, PAIRS), frame(spark, n_true, "s1 string, n_true long")


def f05(n_true, n_pred, tp):
    if not n_true:
        return float(not n_pred)
    if not tp:
        return 0.0
    p, r = tp / n_pred, tp / n_true
    return 1.25 * p * r / (0.25 * p + r)


def macro(kept, n_true):
    return sum(f05(n, sum(k[0] == q for k in kept), sum(k[0] == q and k[4] for k in kept)) for q, n in n_true) / len(n_true)


def by_threshold(rows, t_all, t_top):
    top = {}
    for r in sorted(rows, key=lambda r: (-r[3], r[2])):
        top.setdefault(r[0], r)
    return [r for r in rows if r[3] >= t_all or (top[r[0]] == r and r[3] >= t_top)]


def by_expected_f(rows, c, s):
    kept = []
    for q in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[2]))
        p = [min(max(r[3], 0.0), 1 - 1e-7) for r in own]
        ef = [1.25 * sum(p[:j]) / (j + 0.25 * (sum(p) + c)) for j in range(1, len(p) + 1)]
        if max(ef) > s * math.prod(1 - x for x in p):
            kept += own[: next(j for j, e in enumerate(ef, 1) if e >= max(ef) - 1e-12)]
    return kept


@pytest.mark.parametrize(("pred", "truth", "want"), [({"a", "b", "c"}, {"a", "c"}, 5 / 7), (set(), set(), 1.0), ({"x"}, set(), 0.0), (set(), {"x"}, 0.0)])
def test_f05_of_an_entity(spark, pred, truth, want):
    counts = frame(spark, [(len(truth), len(pred), len(pred & truth))], "t long, n long, tp long")
    assert math.isclose(counts.select(metrics.entity_f05(F.col("t"), F.col("n"), F.col("tp"))).first()[0], want)


def test_threshold_rule(spark):
    pairs = frame(spark, [("q", "a", 0, 0.6, True), ("q", "b", 1, 0.58, True)], PAIRS)
    assert [r.pred for r in decisions.decide_threshold(pairs, 0.725, 0.56).orderBy("blk_rank").collect()] == [True, False]


def test_expected_f_rule(spark):
    pairs = frame(spark, [("q", "a", 0, 0.9, True), ("q", "b", 1, 0.1, True), ("r", "a", 0, 0.05, False)], PAIRS)
    assert [r.pred for r in decisions.decide_expected_f(pairs, 0.0, 1.0).orderBy("s1", "blk_rank").collect()] == [True, False, False]


def test_grids_against_loops(spark):
    rows, n_true, pairs, counts = many(spark)
    assert len(decisions.threshold_grid()) == 880
    for r in decisions.threshold_scores(pairs, counts).sample(0.05, 1).collect():
        assert math.isclose(r.macro_f05, macro(by_threshold(rows, r.t_all, r.t_top), n_true)), r
    for r in decisions.expected_f_scores(pairs, counts).collect():
        assert math.isclose(r.macro_f05, macro(by_expected_f(rows, r.c_missing, r.s_empty), n_true)), r
    best = decisions.best_of(decisions.threshold_scores(pairs, counts)).first()
    scores = [macro(by_threshold(rows, *g), n_true) for g in decisions.threshold_grid()]
    assert math.isclose(best.macro_f05, max(scores)) and math.isclose(scores[best.grid], max(scores))


def test_plain_rule_and_grid(spark):
    rows, n_true, pairs, counts = many(spark, 9)

    def kept(t, alpha, one):
        own = [r for r in rows if r[3] >= t]
        best = {q: max(r[3] for r in own if r[0] == q) for q in {r[0] for r in own}}
        own = [r for r in own if r[3] >= alpha * best[r[0]]]
        if one:
            first = {}
            for r in sorted(own, key=lambda r: (-r[3], r[0])):
                first.setdefault(r[1], r)
            own = list(first.values())
        return own

    named = pairs.withColumnRenamed("c", "cand")
    for t, a, o in ((0.3, 0.8, True), (0.5, 0.5, False), (0.0, 1.0, True)):
        got = decisions.decide_plain(named, t, a, o)
        assert sorted((r.s1, r.cand) for r in got.collect()) == sorted(r[:2] for r in kept(t, a, o))
    scores = decisions.plain_scores(named, counts).collect()
    assert len(scores) == 130
    for r in scores[::7]:
        assert math.isclose(r.macro_f05, macro(kept(r.t, r.alpha, r.one_to_one), n_true)), r


def test_prefilter(spark):
    rows, n_true, pairs, counts = many(spark, 5)
    rule = {"type": "expected_f", "c_missing": 0.2, "s_empty": 0.9}
    table = decisions.prefilter_table(pairs.withColumn("p1", F.col("p") / 5), counts, rule).orderBy("grid").collect()
    for r in table:
        own = [x for x in rows if x[3] / 5 >= r.p1_cutoff]
        assert r.macro_f05 == round(macro(by_expected_f(own, 0.2, 0.9), n_true), 4)
        assert r.candidates_per_entity == round(len(own) / len(n_true), 3)
    chosen = decisions.choose_prefilter(frame(spark, [(0, 0.0, 0.9269), (1, 0.01, 0.9269), (2, 0.1, 0.9268), (3, 0.2, 0.92)], "grid int, p1_cutoff double, macro_f05 double"))
    assert chosen.first()[0] == 0.1
    assert decisions.select_rule([{"n": 1, "tune_f05": 0.91231}, {"n": 2, "tune_f05": 0.91234}])["n"] == 1


def test_splits_are_by_entity_and_stable(spark):
    entities = frame(spark, [(f"S1-{i}",) for i in range(3000)], "entity_id string")
    a = labels.split_entities(entities).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, labels.split_entities(entities.repartition(7)).collect()))
    share = {k: sum(r.role == k for r in a) / len(a) for k in labels.ROLES}
    assert abs(share["fit"] - 0.8) < 0.03 and abs(share["tune"] - 0.1) < 0.03 and {r.fold for r in a} == {0, 1}
    sample = labels.sampled_entities(entities, 50)
    assert sample.count() == 50 and sample.where((F.crc32(F.col("entity_id").cast("binary")) % 10) == 0).count() == 0
    assert {r.fold for r in labels.group_folds(entities).collect()} == set(range(5))


# --- the character-gram plan


def test_grams(spark):
    df = frame(spark, [("ab cde",), ("",), ("a",)], "x string")
    got = [r[0] for r in df.select(char_grams.grams(F.col("x"), 3, 4)).collect()]
    assert sorted(got[0]) == sorted([" ab", "ab ", " ab ", " cd", "cde", "de ", " cde", "cde "]) and got[1] == [] and got[2] == [" a "]


def test_plain_plan_on_a_small_fixture(spark):
    kind = "entity_id string, business_name string, business_address string, country string"
    first = frame(spark, [("S1-1", "International Business Machines", "1 Main St 12345", "US"), ("S1-2", "Acme Widgets Ltd", "5 High Rd", "US"), ("S1-3", "", "", "FR")], kind)
    others = frame(spark, [("S2-1", "International Business Machines Corp", "1 Main Street, 12345", "US"), ("S3-2", "ACME widget limited", "5 High Road", "US"), ("S3-3", "Intl Bakery Makers", "9 Oak Ave", "US"), ("S2-9", "Acme Widgets", "5 High Road", "FR")], kind)
    left, right = (char_grams.plain_records(x) for x in (first, others))
    wide = char_grams.plain_candidates(left, right)
    got = {(r.s1, r.cand): r for r in wide.collect()}
    assert got["S1-1", "S2-1"].n_retrievers == 4 and got["S1-1", "S2-1"].blk_name_cos > 0.9 and ("S1-2", "S2-9") not in got
    assert ("S1-2", "S2-9") in {(r.s1, r.cand) for r in char_grams.plain_candidates(left, right, by_country=False).collect()}
    out = {(r.s1, r.cand): r for r in plain_features.plain_features(wide, left, right).collect()}
    best = out["S1-1", "S2-1"]
    assert (best.core_exact, best.legal_match, best.postal_state, best.num_jacc, best.ctx_rank_in_s1, best.nc_ratio) == (1.0, 0.5, 1.0, 1.0, 1.0, 1.0)
    assert out["S1-2", "S3-2"].legal_match == 1.0 and out["S1-2", "S3-2"].is_s3 == 1.0 and len(plain_features.PLAIN_COLUMNS) == 36
    for r in out.values():
        assert math.isclose(r.ctx_base, 0.5 * r.nc_tset + 0.3 * r.blk_name_cos + 0.2 * r.ad_tset)


def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cheap = ["norm_expand", "norm_core", "plain_name_parts", "keys_addr", "block_topk", "score_macro", "id_lists", "holdout", "validate_repeated", "validate_outside"]
    for name in cheap:
        got, want = queries.QUERIES[name](spark, SF), con.execute(oracle.SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall())), name
    assert oracle.SQL.keys() <= queries.QUERIES.keys()


def test_tables_of_a_scope_are_dropped(spark):
    with staging.dropped(spark):
        inside = staging.staged(spark.range(3), "inside")
        path = inside.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert inside.count() == 3 and os.path.exists(path)
    outside = staging.staged(spark.range(2), "outside")
    assert not os.path.exists(path) and outside.count() == 2


def test_repeated_ids_and_empty_sides(spark):
    corpus = frame(spark, [record("S2-1", "aa"), record("S2-1", "aa"), record("S3-2", "aa bb"), ("S3-3", "x", None, None, "", -1, 0, 0.0)], PREPARED)
    asked = frame(spark, [record("S1-1", "aa"), record("S1-2", "")], PREPARED)
    got = {r.c: r.blk_score for r in retrieval.scored_pairs(asked, corpus, 5).collect()}
    assert got.keys() == {"S2-1", "S3-2"} and got["S2-1"] > got["S3-2"] > 0
    assert retrieval.scored_pairs(asked.limit(0), corpus).count() == retrieval.scored_pairs(asked, corpus.limit(0)).count() == 0


def test_blocks_of_entities_give_the_same_pairs(spark, monkeypatch):
    draw = random.Random(4)
    name = lambda: " ".join(draw.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(3))
    corpus = frame(spark, [record(f"S2-{i:02d}", name(), name(), draw.choice("xy")) for i in range(60)], PREPARED)
    asked = frame(spark, [record(f"S1-{i:02d}", name(), name(), draw.choice("xy")) for i in range(50)], PREPARED)
    every = sorted(map(tuple, retrieval.scored_pairs(asked, corpus, 20).collect()))
    whole = sorted(map(tuple, retrieval.retrieve(asked, corpus, 4, 20).collect()))
    best = {s: sorted((p for p in every if p[0] == s), key=lambda p: (-round(p[2], 6), p[1]))[:4] for s in {p[0] for p in every}}
    assert whole == sorted((*p, i) for own in best.values() for i, p in enumerate(own)) and len(every) > 500
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    monkeypatch.setattr(retrieval, "OUT_ROWS", 10)
    again = retrieval.retrieve(asked, corpus, 4, 20)
    assert sorted(map(tuple, again.collect())) == whole
    assert sorted(map(tuple, retrieval.scored_pairs(asked, corpus, 20).collect())) == every
    assert "explode(cs" not in again._jdf.queryExecution().optimizedPlan().toString()


def test_lists_are_packed_as_gaps_and_keys_of_both_sides_shuffled_once(spark):
    draw = random.Random(6)
    lists = [sorted(draw.sample(range(draw.choice([50, 300, 10**6, 2**40])), draw.randrange(1, 40))) for _ in range(200)] + [[0], [127], [128, 2**31]]
    packed = retrieval._packed(np.array(sum(lists, []), np.int64), np.array([len(x) for x in lists]))
    for a, b in ((0, 203), (7, 60), (201, 203)):
        values, lengths = retrieval._unpacked(packed.slice(a, b - a), np.int64)
        assert values.tolist() == sum(lists[a:b], []) and lengths.tolist() == [len(x) for x in lists[a:b]]
    corpus = frame(spark, [record("S2-1", "aa bb"), record("S3-2", "aa cc")], PREPARED)
    asked = frame(spark, [record("S1-1", "aa"), record("S1-2", "cc")], PREPARED)
    pairs, *_ = retrieval._number_pairs(asked, corpus, 5, 3)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(country#\d+, field#\d+, key#\d+", plan)) == 1


def test_shares_of_pairs_give_all_rows_and_leave_no_shuffles(spark, monkeypatch):
    pairs = spark.createDataFrame([(f"S1-{i % 17}", f"S2-{i}") for i in range(90)], "s1 string, c string")
    texts = spark.createDataFrame([(f"S2-{i}", "x" * i) for i in range(90)], "c string, txt string")
    calls = []

    def work(share):
        calls.append(share.count())
        return share.join(texts.hint("merge"), "c").groupBy("s1").agg(F.sum(F.length("txt")).alias("n"))

    shuffles = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    whole = sorted(map(tuple, work(pairs).collect()))
    monkeypatch.setattr(staging, "SHARE_ROWS", 20)
    calls.clear()
    got = staging.in_shares(pairs, work)
    assert len(calls) == 5 and sum(calls) == 90 and max(calls) < 60
    assert sorted(map(tuple, got.collect())) == whole
    before = shuffles.size()
    staging.staged(pairs.repartition(3, "c").groupBy("s1").count(), "once")
    for _ in range(50):
        if shuffles.size() <= before:
            break
        time.sleep(0.2)
    assert shuffles.size() <= before


def test_truth_among_pairs_is_what_truth_has_of_them(spark):
    corpus = frame(spark, [record("S2-1", "aa", "x"), record("S2-2", "aa", "x"), record("S2-3", "aa", "y"), record("S2-4", ""), record("S2-5", "aa", "x", "other")], PREPARED)
    asked = frame(spark, [record("S1-1", "aa", "x"), record("S1-2", ""), record("S1-3", "aa", "x")], PREPARED)
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-3"), ("S1-2", "S2-4"), ("S1-3", "S2-2"), ("S1-3", "S2-5")], "s1 string, c string")
    got = sorted(map(tuple, queries.known_pairs(pairs, asked, corpus).collect()))
    assert got == sorted(map(tuple, queries.truth(asked, corpus).join(pairs, ["s1", "c"], "left_semi").collect())) == [("S1-1", "S2-1"), ("S1-3", "S2-2")]


def test_pairs_of_large_sides_are_named_in_their_blocks_and_not_shuffled(spark, monkeypatch):
    for module in (staging, retrieval):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 10, raising=False)
    draw = random.Random(8)
    name = lambda: " ".join(draw.choice(["aa", "bb", "cc", "dd"]) for _ in range(3))
    corpus = frame(spark, [record(f"S2-é{i}" + "x" * i, name()) for i in range(40)], PREPARED)
    asked = frame(spark, [record(f"S1-{i}", name()) for i in range(30)], PREPARED)
    pairs = retrieval.scored_pairs(asked, corpus, 100)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Join" not in above and "Exchange" not in above
    want = {(a.entity_id, c.entity_id) for a in asked.collect() for c in corpus.collect() if {*a.name_core.split()} & {*c.name_core.split()}}
    assert {(r.s1, r.c) for r in pairs.collect()} == want and len(want) > 500


def test_keys_are_indexed_in_arrays_in_pieces_and_none_is_a_row(spark, monkeypatch):
    draw = random.Random(9)
    text = lambda: draw.choice([None, "", " ".join(draw.choice(["aa", "bb", "é", "éé", "5", "٣", "x", "dd"]) for _ in range(draw.randrange(9)))])
    sides = [[(draw.choice("xy"), text(), text(), n) for n in range(many)] for many in (40, 70)]

    def keys(row):
        for field, text, serves in (("n", row[1], lambda w: len(w) > 1), ("a", row[2], lambda w: len(w) > 1 or w.isdecimal())):
            words = [w for w in (text or "").split(" ") if w and serves(w)]
            yield from {(row[0], field, w) for w in words} | {(row[0], field, *w) for w in zip(words, words[1:])}

    cap, df, n = 9, Counter(k for r in sides[1] for k in keys(r)), Counter(r[0] for r in sides[1])
    want = Counter()
    for a in sides[0]:
        for c in sides[1]:
            if met := [k for k in {*keys(a)} & {*keys(c)} if df[k] <= cap]:
                want[a[3], c[3]] = sum(math.log1p(n[k[0]] / df[k]) for k in met)
    monkeypatch.setattr(retrieval, "INDEX_BYTES", 200)
    monkeypatch.setattr(retrieval, "AT_ONCE", 30)
    monkeypatch.setattr(retrieval, "DEALT_ROWS", 4)
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32()]
    index = []
    for of_corpus, rows in enumerate(sides):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 7]), kinds)], ["country", "name", "addr", "n"]) for i in range(0, len(rows), 7)]
        index += retrieval._indexed(bool(of_corpus), 3, cap)(iter(batches))
    index = [pa.RecordBatch.from_arrays([*b.columns, pa.array([n[b.column(0)[0].as_py()]])], [*b.schema.names, "of_country"]) for b in index]
    assert len(index) > 40
    index.sort(key=lambda b: [b.column(i)[0].as_py() for i in range(3)])
    met = sorted(retrieval._dealt(2, cap)(iter(index)), key=lambda b: b.column(0)[0].as_py())
    got = [r for b in retrieval._met(70, None, (np.int32, np.int32))(iter(met)) for r in b.to_pylist()]
    assert {(r["s1"], r["c"]): round(r["blk_score"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()} and len(got) == len(want) > 100
    # keys that agree in 64 bits are told apart by the others
    by, new = retrieval._runs(np.array([5, 3, 5, 5], np.uint64), np.array([1, 1, 2, 1], np.uint32))
    assert new.tolist() == [True, True, False, True] and by.tolist() == [1, 0, 3, 2]
    corpus, asked = frame(spark, [record("S2-1", "aa bb")], PREPARED), frame(spark, [record("S1-1", "aa")], PREPARED)
    plan = retrieval._number_pairs(asked, corpus, 5, 3)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan
