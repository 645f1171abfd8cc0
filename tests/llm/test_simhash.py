import random

import numpy as np
import pytest
import xxhash

from ligature.llm import shingles, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = list(range(len(fps)))
    changed = True
    near = [[j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3] for i in range(len(fps))]
    while changed:
        changed = False
        for i, js in enumerate(near):
            low = min(label[j] for j in js)
            if low < label[i]:
                label[i], changed = low, True
    return label


@pytest.mark.parametrize("text", ["", None, "One", "Zwei Wörter", "a b\tc\n\x0bd\x0ce  f", "nb sp  x", "Ä" * 3000])
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint((text or "").encode())) == brute_fingerprint(text)


def test_links_of_any_pattern_connect_as_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 16)
    draw = random.Random(5)
    fps = []
    for _ in range(120):
        fp = draw.getrandbits(64) & draw.getrandbits(64)
        for _ in range(draw.choice([1, 1, 2, 5])):
            fps.append(fp)
            for b in draw.sample(range(64), draw.choice([1, 2, 3, 3, 3, 4])):
                fp ^= 1 << b
    fps = sorted({0, 2**64 - 1, 7, *fps})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.ball_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    from ligature.llm.components import components

    roots = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    got = [roots.get(x, x) for x in signed]
    want = brute_components(fps)
    assert [got.index(x) for x in got] == [want.index(x) for x in want]


def test_components_of_rows(spark):
    rows = [(7, "same words here and there", "en", "a", 1), (3, "same words here and there", None, None, None), (5, "", "en", "b", 0), (9, None, "en", "b", 0), (None, "lone text of its own", "x", "y", 2), (4, "!", "q", "q", 1), (4, "!", "q", "q", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as fp", "2 as component_id", "3 as rep", "4 as _kept")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == [(-1, None), (3, 3), (4, 4), (4, 4), (5, 5), (7, 3), (9, 5)]
    kept = shingles.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 4, 5]
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_chain_and_star(spark):
    from ligature.llm.components import components

    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(1, 1), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(200, 260)}
