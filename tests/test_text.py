import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.functions import vector as vx


def one(spark, column, value, schema="string"):
    return spark.createDataFrame([(value,)], f"t {schema}").select(column.alias("x")).first().x


def test_normalize(spark):
    assert one(spark, tx.normalize("t"), "a   b\tc\n") == "a b c"
    assert one(spark, tx.normalize("t"), "  é  x ") == "é x"
    assert one(spark, tx.normalize("t"), None) is None
    twice = tx.collapse(tx.nfc(F.lit("a  b")))
    assert one(spark, twice, "") == "a b"
    assert one(spark, tx.normalize("t", token_prep=lambda c: F.upper(c)), "a b") == "A B"


def test_white_space_equals_python(spark):
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, chr(c)) for c in points], "c int, t string")
    got = {r.c for r in df.filter(F.col("t").rlike(f"^{tx.WS}$")).collect()}
    assert got == {c for c in points if chr(c).isspace()}


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=200, max_size=200))
def test_normalize_properties(spark, texts):
    texts = [t for t in texts if all(not 0xD800 <= ord(c) < 0xE000 for c in t)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.normalize("t").alias("n")).withColumn("again", tx.normalize("n"))
    for r in df.collect():
        assert r.again == r.n
        assert r.n == " ".join(unicodedata.normalize("NFC", r.t).split())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The first sentence is here. The second one follows now.", ["The first sentence is here.", "The second one follows now."]),
        ("«Куда вы идёте сегодня?» — спросил. Он молчал очень долго.", ["«Куда вы идёте сегодня?» — спросил.", "Он молчал очень долго."]),
        ("Is this really true?! (Yes, it certainly is.)", ["Is this really true?!", "(Yes, it certainly is.)"]),
        ("A line with a hyphen-\nated word in it.\n12\nAnd then another whole line.", ["A line with a hyphenated word in it.", "And then another whole line."]),
        ("Too short. Also. A sentence that is long enough stays.", ["A sentence that is long enough stays."]),
        ("", []),
    ],
)
def test_split_sentences(spark, text, want):
    assert one(spark, tx.split_sentences("t"), text) == want


def test_small_functions(spark):
    assert one(spark, tx.is_junk_line("t"), " 12 ") is True
    assert one(spark, tx.is_junk_line("t"), "12a") is False
    assert one(spark, tx.word_count("t"), " a b　c ") == 3
    assert one(spark, tx.shingles("t"), "a b") == ["a b"]
    assert one(spark, tx.shingles("t"), "a b c d e f a b c d e") == ["a b c d e", "b c d e f", "c d e f a", "d e f a b", "e f a b c", "f a b c d"]
    assert one(spark, tx.shingles("t"), " ") == []
    assert one(spark, tx.terms("t"), "Ab c ગુજરાતી x1") == ["ab", "જર", "x1"]
    assert one(spark, tx.pretokens("t"), "Hi, ગુજરાતી!!") == ["Hi", ",", "ગુજરાતી", "!!"]
    assert one(spark, tx.instruction_prompt(F.lit("Represent X"), F.col("t")), "hello") == "Instruct: Represent X\nQuery: hello"
    assert one(spark, tx.instruction_prompt(F.lit(" "), F.col("t")), "hello") == "hello"
    assert one(spark, tx.prefix_prompt(F.lit("Find"), F.col("t")), "x") == "Find: x"
    assert one(spark, tx.has_abbreviation_shape("t"), "e.g.") and not one(spark, tx.has_abbreviation_shape("t"), "1.5")
    assert one(spark, tx.nfkc("t"), "ﬁ") == "fi"
    import hashlib

    assert one(spark, tx.cache_key(F.lit("g"), F.lit("ru"), F.lit("en"), F.col("t")), "x") == hashlib.sha1(b"g|ru|en|x").hexdigest()


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(vx.cosine("a", "b").alias("c"), vx.unit("a").alias("u"), vx.norm("a").alias("n")).collect()
    assert abs(rows[0].c - 0.96) < 1e-9 and rows[0].u == [0.6, 0.8] and rows[0].n == 5.0
    assert rows[1].c == 0.0 and rows[1].u == [0.0, 0.0]
    u = spark.createDataFrame([(x,) for x in (0.5, 1.0, 0.0, -0.5, 1.5)], "c double").select(vx.uncertainty(F.col("c")).alias("u"))
    assert [r.u for r in u.collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_last_token(spark):
    last = lambda masks: [r["last"] for r in vx.last_token_index(spark.createDataFrame([(m,) for m in masks], "mask array<int>")).collect()]
    assert sorted(last([[1, 1, 1], [1, 1, 0]])) == [1, 2]
    assert last([[1, 1, 1], [0, 1, 1]]) == [2, 2]
    assert vx.jsonl_bytes(spark.createDataFrame([([1.0] * 4,)] * 3, "embedding array<float>")).first().bytes == 3 * 4 * 18
