import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(draw, n, pool=400):
    return " ".join(f"w{draw.randrange(pool)}" for _ in range(n))


def small_rows():
    """Nulls in any column, empty and very long texts, repeated rows, ties."""
    draw = random.Random(11)
    long = words(draw, 30_000)
    shared = words(draw, 60)
    rows = [(i, words(draw, draw.randrange(1, 80)), draw.choice(["en", "fr", None]), f"src{i % 3}", 5) for i in range(30)]
    rows += [
        (100, None, "en", "src1", None),
        (101, "", None, None, 0),
        (None, "no id here, but a text", "en", "src0", 3),
        (None, None, None, None, None),
        (102, long, "en", "src0", 9),
        (103, long, "en", "src2", 9),
        (104, shared, "de", "src1", 1),
        (104, shared, "de", "src1", 1),
        (105, "before " + shared + " after", "de", None, 1),
        (106, "\n\n \t", "es", "src1", 4),
        (106, "Ünï çödé 漢字 " * 40, "es", "src1", 4),
    ]
    return rows


@pytest.fixture
def docs(spark):
    """The rows, with columns more than the operators need, named as they name theirs."""
    extra = ["1 as fp", "2 as rep", "3 as h", "4 as shard", "5 as shard_bytes", "6 as size", "7 as copies", "8 as row", "9 as bucket", "10 as n", "11 as line", "12 as score", "13 as part", "14 as doc", "15 as x", "16 as target", "17 as _copy", "18 as component_id"]
    return spark.createDataFrame(small_rows(), SCHEMA).selectExpr("*", *extra)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
