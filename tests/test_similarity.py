import math
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ligature.functions import similarity as sim


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
    return row[-1]


def plain_ratio(a, b):
    return 200 * subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", max_size=14), st.text("abcé ", max_size=14))
def test_kernels(a, b):
    assert sim.common_subsequence(a, b) == subsequence(a, b)
    assert math.isclose(sim.indel_ratio(a, b), plain_ratio(a, b))
    short, long = sorted((a, b), key=len)
    n = len(short)
    windows = [long[i : i + n] for i in range(len(long) - n + 1)] + [long[:k] for k in range(1, n)] + [long[-k:] for k in range(1, n)]
    want = max(plain_ratio(short, w) for w in windows) if a and b else (100.0 if a == b else 0.0)
    assert math.isclose(sim.partial_ratio(a, b), want)
    assert 0 <= sim.jaro_winkler(a, b) <= 1 and sim.jaro_winkler(a, a) == 1


@pytest.mark.parametrize(("a", "b", "want"), [("martha", "marhta", 0.961111), ("dwayne", "duane", 0.84), ("", "", 1.0), ("", "a", 0.0), ("dixon", "dicksonx", 0.813333)])
def test_jaro_winkler(a, b, want):
    assert round(sim.jaro_winkler(a, b), 6) == want


def set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = (f"{both} {side}".strip() for side in (left, right))
    found = [plain_ratio(one, two)]
    return max(found + ([plain_ratio(both, one), plain_ratio(both, two)] if both else []))


def test_token_similarities(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abc") for _ in range(draw.randrange(1, 5)))
    text = lambda: " ".join(word() for _ in range(draw.randrange(5)))
    pairs = [(text(), text()) for _ in range(200)] + [("", ""), ("a", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", sim.token_sort(a, b).alias("s"), sim.token_set(a, b).alias("t"), sim.jaccard(a, b).alias("j")).collect():
        x, y = set(r.a.split()), set(r.b.split())
        assert math.isclose(r.s, plain_ratio(" ".join(sorted(r.a.split())), " ".join(sorted(r.b.split()))))
        assert math.isclose(r.t, set_ratio(r.a, r.b)), (r.a, r.b)
        assert r.j == (len(x & y) / len(x | y) if x and y else None)


def test_word_sets_of_a_batch_meet_in_arrays():
    draw = random.Random(7)
    text = lambda: draw.choice([None, "", " ", " ".join(draw.choice(["a", "b", "", "é", "cc"]) for _ in range(draw.randrange(8)))])
    a, b = ([text() for _ in range(500)] for _ in "ab")
    got = sim._jaccards(pa.array(a, pa.string()), pa.array(b, pa.string())).to_pylist()
    sets = [[{w for w in (x or "").split(" ") if w} for x in side] for side in (a, b)]
    assert got == [len(x & y) / len(x | y) if x and y else None for x, y in zip(*sets, strict=True)]
    assert sim._jaccards(pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []
