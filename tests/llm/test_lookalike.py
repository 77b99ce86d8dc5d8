import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import lookalike as L


def forms(spark, texts, schema="id int, sentence_a string, word string", **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], schema)
    return {(r.id, texts[r.id]): (r.skeleton, r.form) for r in L.consistent_texts(df, "id", ["sentence_a"], **options).collect()}


def test_same_look_same_form(spark):
    same = ["The café  ﬁts", "Ｔhe café fits", " The ca​fé fi­ts　", "Тhe саfé fits"]
    got = {f for f in forms(spark, same).values()}
    assert got == {("The café fits", "The café fits")}


def test_real_differences_stay(spark):
    texts = ["Cafe", "cafe", "café", "cafe.", "cafe…", "cafe’", "cafe'", "m2", "m²"]
    assert len({f for f in forms(spark, texts).values()}) == len(texts)


def test_readable_form_follows_script(spark):
    got = forms(spark, ["Bсе кoты A тут", "A cop sat", "લોકોએ ગયા", "лёд̆"])
    by = {k[0]: v[1] for k, v in got.items()}
    assert by[0] == "Все коты А тут"
    assert by[1] == "A cop sat"
    assert by[2] == "લોકોએ ગયા"


def test_marks_are_ordered(spark):
    a, b = "ạ́", "ạ́"
    assert len(set(forms(spark, [a, b]).values())) == 1


def test_edges(spark):
    got = forms(spark, [None, "", " ​ ", "x" * 50_000 + "é"])
    assert got[(0, None)] == (None, None)
    assert got[(1, "")] == ("", "")
    assert got[(2, " ​ ")] == ("", "")
    assert got[(3, "x" * 50_000 + "é")][1] == "x" * 50_000 + "é"
    empty = spark.createDataFrame([], "id int, sentence_a string")
    assert L.consistent_texts(empty, "id", ["sentence_a"]).count() == 0


def test_pairs_against_brute_force(spark):
    texts = ["ab cd", "аb cd", "ab  cd", "ab cd", "AB cd", None, "ab ce", "ａb cd"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "id int, sentence_a string, sentence_b string")
    got = {tuple(r) for r in L.same_look_pairs(L.item_forms(df.union(df)), "id").collect()}
    want = set()
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            b = texts[j]
            if a is not None and b is not None and a != b and L.fold_text(a) == L.fold_text(b):
                want |= {(i, j, "sentence_a"), (i, j, "sentence_b")}
    assert got == want and want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x3FF), max_size=20))
def test_fold_text_is_idempotent(text):
    once = L.fold_text(text)
    assert L.fold_text(once) == once
    assert L.fold_text(unicodedata.normalize("NFD", text)) == once


def test_operator_equals_plain_python(spark):
    texts = ["a \x01b\x7f\t\x0bc\x1c ", " \x00 ", "a\n", "À Vеnv", "ｆüｒ №4 ﬂöße", "Hиктo нe", "ઓરડો અને", "x⁠y z", "﻿", "ά ΐ", "가나 다", "Ⅳ ½ …"]
    got = forms(spark, texts)
    assert {k[1]: v[0] for k, v in got.items()} == {t: L.fold_text(t) for t in texts}


def test_direct_path_equals_exploding(spark):
    rng = random.Random(7)
    signs = "".join(map(chr, range(128)))
    texts = ["".join(rng.choice(signs + "abcxyzABC  ") for _ in range(rng.randrange(0, 30))) for _ in range(150)]
    texts += [t + " саfé ок" for t in texts[:40]] + ["", "plain words here", "A cop sat"]
    direct, exploded = forms(spark, texts), forms(spark, texts, direct=False)
    assert direct == exploded and {k[1]: v[0] for k, v in direct.items()} == {t: L.fold_text(t) for t in texts}


def test_other_tables(spark, tmp_path):
    file = tmp_path / "confusables.txt"
    file.write_text("\ufeff# remark\n13AA ; 0041 ; MA # GO\n\n03B1 ;\t0061 ;\tMA\t# alpha\n0041 ; 0391 ; MA # ASCII stays\n0063 0301 ; 0107 ; MA\n0439 ; 0069 0069 ; MA\n", encoding="utf-8")
    like = L.read_confusables(str(file))
    assert like == {"\u13aa": "A", "\u03b1": "a", "\u0439": "ii"}
    texts = ["\u13aab", "Ab", "c\u03b1t", "cat", "\u0439", "ii", "\u0430"]
    got = [v[0] for _, v in sorted(forms(spark, texts, like=L.LOOKALIKE | like).items())]
    assert got == ["Ab", "Ab", "cat", "cat", "ii", "ii", "a"]
    assert [v[0] for _, v in sorted(forms(spark, texts, like=like).items())][-1] == "\u0430"


def test_many_spellings_and_classes(spark, monkeypatch):
    texts = ["x" + "\u200b" * i for i in range(40)] + [" " * i for i in range(12)] + [None, "y"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "id int, sentence_a string, sentence_b string")
    f = L.item_forms(df)
    want = {(i, j, "sentence_a") for i in range(52) for j in range(i + 1, 52) if (i < 40) == (j < 40)}
    assert {tuple(r) for r in L.same_look_pairs(f, "id").collect()} == want
    blocked = L.blocked
    monkeypatch.setattr(L, "blocked", lambda rows, keys, by: blocked(rows, keys, by, 5))
    assert {tuple(r) for r in L.same_look_pairs(f, "id").collect()} == want
    got = {r.id: r.class_id for r in L.look_classes(f, "id").filter("field = 'sentence_a'").collect()}
    assert got == {i: None if t is None else 0 if i < 40 else 40 if i < 52 else 53 for i, t in enumerate(texts)}
