import corpus_pipeline
from pyspark.sql import functions as F

from ligature.llm import decontamination, shingles
from ligature.llm.common import stored

from .conftest import SCHEMA, SF


def shingle_set(text):
    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def test_each_stage_does_what_its_operator_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    named = dict(corpus_pipeline.STAGES)
    assert list(named) == ["language", "simhash", "decontamination", "mixing", "sharding"]
    known = stored(named["language"](spark, docs, SF), "test")
    assert known.columns == columns and known.count() == docs.where("text rlike '\\\\p{L}'").count()
    single = stored(named["simhash"](spark, known, SF), "test")
    rows = sorted(known.collect(), key=lambda r: r.doc_id)
    sets = [shingle_set(r.text) for r in rows]
    least = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                one, other = sorted((least[i], least[j]))
                least = [one if x == other else x for x in least]
    assert sorted(r.doc_id for r in single.collect()) == sorted({rows[i].doc_id for i in least}) != sorted(r.doc_id for r in rows)
    clean = stored(named["decontamination"](spark, single, SF), "test")
    hits = decontamination.judged(decontamination.benchmark_hits(single, spark.read.parquet(f"{SF}/benchmark.parquet")))
    bad = {r.row.doc_id for r in hits.collect() if r.contaminated}
    assert bad and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - bad
    mixture = stored(named["mixing"](spark, clean, SF), "test")
    assert mixture.columns == columns and {r.doc_id for r in mixture.collect()} <= {r.doc_id for r in clean.collect()}
    final = named["sharding"](spark, mixture, SF)
    assert {*final.columns} == {*columns, "shard", "shard_bytes"} and final.count() == mixture.count()
    assert sorted(map(repr, final.collect())) == sorted(map(repr, corpus_pipeline.run(spark, SF).collect()))


def test_odd_rows_pass_through(spark, docs, no_docs):
    out = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0
        out = stored(stage(spark, out, SF), "test")
    assert out.count() > 20
    assert shingles.drop_near_copies(docs).count() < docs.count()


def test_one_row_of_each_group_stays(spark):
    """Different texts under one doc_id all stay, rows without one are told apart, and reruns agree."""
    one, two, three = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(5, one, "en", "x", 1), (5, two, "en", "x", 1), (None, one.upper(), "en", "y", 1), (None, three, "fr", "z", 1), (None, three + " more", "fr", "z", 2), (7, two, "de", "w", 1), (5, one, "en", "a", 3), (None, None, None, None, None), (9, "", "en", "x", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    runs = [sorted(map(repr, shingles.drop_near_copies(docs.orderBy(F.rand(k))).collect())) for k in (1, 2)]
    assert runs[0] == runs[1] and len(runs[0]) == 4
    kept = shingles.drop_near_copies(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.text)[1:] == [(5, one), (5, two)]
