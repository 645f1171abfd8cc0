import unicodedata

import pytest
from pyspark.sql import functions as F

from ligature.functions import plain_text, text

CLEAN = [
    ("Cáble & Co. Pvt-Ltd", "cable company private limited", "cable"),
    ("Joe's Bar", "joes bar", "joes bar"),
    ("Joe’s Bar", "joes bar", "joes bar"),
    ("12 N. Main St, Ste 4", "12 north main street suite 4", "12 north main street suite 4"),
    ("The Acme_Co of LLC", "the acme company of llc", "acme"),
    ("  ", "", ""),
    (None, "", ""),
    ("", "", ""),
    ("किताब", "क त ब", "क त ब"),
    ("ÉCOLE ½ Straße", "ecole 1 2 straße", "ecole 1 2 straße"),
]


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("given", "normal", "core"), CLEAN)
def test_normalize(spark, given, normal, core):
    assert one(spark, given, text.normalize) == normal
    assert one(spark, given, lambda x: text.core_name(text.normalize(x))) == core


def test_marks_go_by_combining_class(spark):
    marks = [chr(c) for c in range(0x300, 0x1FFFF) if unicodedata.combining(chr(c))]
    others = [chr(c) for c in range(0x300, 0x3000) if unicodedata.category(chr(c)) in ("Mc", "Mn") and not unicodedata.combining(chr(c)) and unicodedata.normalize("NFKD", chr(c)) == chr(c)]
    assert one(spark, "".join(marks), text.strip_accents) == ""
    assert one(spark, "".join(others), text.strip_accents) == "".join(others)


@pytest.mark.parametrize(
    ("column", "given", "want"),
    [
        (text.number_tokens, "26 6 26 road 515", "26 515 6"),
        (text.number_tokens, "", ""),
        (text.first_number, "no digits", -1),
        (text.first_number, "unit 007 b", 7),
        (text.first_number, "१२ main", 12),
        (text.first_number, "1234567890123456789", 123456789012345),
        (text.token_count, "", 0),
        (text.token_count, "a b", 2),
        (text.non_ascii_share, "né", 0.5),
        (text.non_ascii_share, "", 0.0),
        (text.non_ascii_share, None, 0.0),
        (text.country_label, " India ", "india"),
        (text.country_label, None, ""),
        (text.name_keys, "blue x anvil", ["n:blue", "n:anvil", "nb:blue_anvil"]),
        (text.name_keys, "", []),
        (text.name_keys, "one", ["n:one"]),
        (text.address_keys, "5 b main", ["a:5", "a:main", "ab:5_main"]),
        (plain_text.basic_clean, "A&B+C Ünï किताब", "a and b and c uni"),
        (plain_text.country_key, "—", "unknown"),
        (plain_text.postal_code, "Sector 9, 560 001", ""),
        (plain_text.postal_code, "Dallas 12345 6789", "123456"),
        (plain_text.postal_code, "PIN 560001", "560001"),
        (plain_text.postal_code, None, ""),
        (plain_text.acronym, "international business machines", "ibm"),
        (plain_text.acronym, "bank of the west", "bw"),
        (plain_text.acronym, "ibm", ""),
        (plain_text.first_token, "", ""),
        (plain_text.first_token, "a b", "a"),
    ],
)
def test_columns(spark, column, given, want):
    assert one(spark, given, column) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("The Acme Mfg Pvt Ltd", ("the acme manufacturing pvt ltd", "acme manufacturing", "ltd pvt")),
        ("Limited", ("limited", "limited", "ltd")),
        ("Ltd Acme", ("ltd acme", "ltd acme", "")),
        ("The", ("the", "the", "")),
        ("", ("", "", "")),
        (None, ("", "", "")),
    ],
)
def test_name_parts(spark, given, want):
    assert tuple(one(spark, given, plain_text.name_parts)) == want


def test_addresses_by_country(spark):
    rows = [("12 St R", "France", "12 saint rue"), ("12 st mg", "India", "12 street mahatma gandhi"), ("12 St R", "Peru", "12 street r"), (None, None, "")]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, c string")
    assert [r[0] for r in df.select(plain_text.plain_address(F.col("a"), F.col("c"))).collect()] == [r[2] for r in rows]


def test_hold_out_is_a_stable_hash(spark):
    import zlib

    ids = [f"S1-{i}é" for i in range(200)]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "x string").select(text.held_out(F.col("x"))).collect()]
    assert got == [zlib.crc32(i.encode()) % 10 == 0 for i in ids]
