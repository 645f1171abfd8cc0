import random

import duckdb
import pytest

from ligature.llm import lines, queries

from .test_operators import distance


def test_short_lines_against_all_pairs(spark, tmp_path):
    draw = random.Random(6)
    base = ["".join(draw.choice("etnairso xü") for _ in range(n)) for n in (1, 2, 3, 4, 5, 7, 9, 12, 16, 20, 24, 29, 33)]

    def edited(line):
        line = list(line)
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(line) + 1)
            line[at : at + draw.randrange(2)] = draw.choice(["", "q", "é"])
        return "".join(line)

    rows = [(i, "\n".join(edited(draw.choice(base)) for _ in range(6))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first = {}
    for doc, text in rows:
        for n, line in enumerate(text.split("\n")):
            first.setdefault(line, (doc, n))
    told = [x for x in first if x.strip(" ")]
    near = {b for b in told for a in told if first[a] < first[b] and distance(a, b) <= 2}
    want = {doc: ",".join(str(n) for n, x in enumerate(text.split("\n")) if x.strip(" ") and (x in near or first[x] != (doc, n))) for doc, text in rows}
    got = {r.doc_id: r.removed for r in queries.QUERIES["op9_lines"](spark, str(tmp_path)).collect()}
    assert any(len(x) < 30 for x in near) and got == want


@pytest.mark.parametrize("fields", [1, 2])
def test_many_lines_of_one_template(spark, fields):
    """Ten thousand lines that share most segments."""
    draw = random.Random(9)
    numbers = [f"{n:06d}" for n in draw.sample(range(10**6), 10_000)]
    if fields == 2:
        numbers = [f"{n[:3]} of row {n[3:]}" for n in numbers]
    rows = [(i, "\n".join(f"Item {n} of the catalogue, with its price" for n in numbers[i * 100 : i * 100 + 100])) for i in range(100)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?) AS n, unnest(range(10000)) AS i", [numbers])
    want = {i for (i,) in con.execute("SELECT DISTINCT b.i FROM t a, t b WHERE a.i < b.i AND levenshtein(a.n, b.n) <= 2").fetchall()}
    got = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert want and {r.doc_id * 100 + n for r in got for n in r.removed} == want
