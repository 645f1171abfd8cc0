import random

import xxhash

import corpus_pipeline
from ligature.llm import shingles

from .conftest import SF, words
from .test_simhash import SCHEMA, brute_components, brute_fingerprint


def parts(text):
    found = text.lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute(sets):
    label = list(range(len(sets)))
    near = [[j for j in range(len(sets)) if similar(sets[i], sets[j])] for i in range(len(sets))]
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            low = min(label[j] for j in js)
            if low < label[i]:
                label[i], changed = low, True
    return label


def rows_of_copies():
    """Texts of about a hundred words, with one to four words changed in some, and copies of copies."""
    draw = random.Random(3)
    texts = ["", None, "one", "One ", "a b c d e"]
    for _ in range(30):
        text = words(draw, 100, 5000).split()
        for _ in range(draw.randrange(1, 5)):
            texts.append(" ".join(text))
            for _ in range(draw.randrange(1, 5)):
                text[draw.randrange(len(text))] = f"x{draw.randrange(5000)}"
    return [(i, text, "en", "a", 1) for i, text in enumerate(texts)]


def test_near_copies_that_fingerprints_miss_go(spark):
    rows = rows_of_copies()
    label = brute([parts(r[1] or "") for r in rows])
    assert label != brute_components([brute_fingerprint(r[1]) for r in rows])
    docs = spark.createDataFrame(rows, SCHEMA)
    groups = {r.h: r.root for r in shingles.shingle_groups(docs).collect()}
    of = [groups[xxhash.xxh64(b" ".join((r[1] or "").lower().encode().split())).intdigest() - (1 << 64) * (xxhash.xxh64(b" ".join((r[1] or "").lower().encode().split())).intdigest() >> 63)] for r in rows]
    assert [of.index(x) for x in of] == label
    kept = corpus_pipeline.deduplicate(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


def test_crowded_bands_link_as_all_pairs_do(spark, monkeypatch):
    """Some of the texts share a passage without being alike, some are variants of one template; each band of three texts counts as crowded."""
    monkeypatch.setattr(shingles, "CROWD", 2)
    draw = random.Random(9)
    passage, template = words(draw, 60, 5000), words(draw, 120, 5000).split()
    texts = [r[1] for r in rows_of_copies()[:40]] + [f"{passage} {words(draw, 30, 5000)}" for _ in range(12)]
    for _ in range(25):
        own = list(template)
        for _ in range(draw.randrange(5)):
            own[draw.randrange(len(own))] = f"y{draw.randrange(5000)}"
        texts.append(" ".join(own))
    draw.shuffle(texts)
    rows = [(i, text, "en", "a", 1) for i, text in enumerate(texts)]
    label = brute([parts(text or "") for text in texts])
    kept = shingles.drop_near_copies(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


def test_pairs_that_share_one_crowded_band_alone_are_linked(spark, monkeypatch):
    """Also where no other band, and where the crowded group is one of fingerprints; and where the prefixes are crowded as well."""
    monkeypatch.setattr(shingles, "CROWD", 2)
    draw = random.Random(13)
    common = words(draw, 40, 5000)
    texts = []
    for i in range(9):
        text = f"{common} {words(draw, 80, 5000)}".split()
        texts.append(" ".join(text))
        for _ in range(i % 4):
            text[50 + draw.randrange(70)] = f"z{draw.randrange(5000)}"
            texts.append(" ".join(text))
    sets = [parts(x) for x in texts]
    label = brute(sets)
    docs = spark.createDataFrame([(i, x, "en", "a", 1) for i, x in enumerate(texts)], SCHEMA).cache()
    hashes = {r.doc_id: r.t for r in docs.selectExpr("doc_id", f"{shingles.TEXT_HASH} as t").collect()}
    for one_band in (True, False):
        bands = [[7 if one_band and j == 3 else 1000 * i + j for j in range(shingles.BANDS)] for i in range(len(texts))]
        made = [(hashes[i], 0 if not one_band else draw.randrange(1 << 62), len(sets[i]), bands[i]) for i in range(len(texts))]
        reps = spark.createDataFrame(made, "t long, fp long, size long, bands array<long>")
        links = {(r.u, r.v) for r in shingles.shingle_links(docs, reps).collect()}
        own = list(range(len(texts)))
        for u, v in links:
            a, b = (own[next(i for i in hashes if hashes[i] == x)] for x in (u, v))
            own = [min(a, b) if x in (a, b) else x for x in own]
        assert own == label


def test_links_connect_as_all_pairs_do():
    draw = random.Random(4)
    texts = [r[1] or "" for r in rows_of_copies()]
    draw.shuffle(texts)
    sets = [parts(x) for x in texts]
    label = list(range(len(texts)))
    for i, j in shingles._linked([shingles.shingles(x.encode()) for x in texts]):
        assert similar(sets[i], sets[j])
        old, new = max(label[i], label[j]), min(label[i], label[j])
        label = [new if x == old else x for x in label]
    assert label == brute(sets)


def test_sets_of_any_length_have_bands():
    assert len(shingles.bands(shingles.shingles(b""))) == shingles.BANDS
    long = " ".join(map(str, range(3000))).encode()
    assert len(shingles.shingles(long)) == 2996 and len(set(shingles.bands(shingles.shingles(long)).tolist())) == shingles.BANDS
