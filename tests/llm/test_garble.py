import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import garble as G
from lexmill.llm.bits import bit_set, bits_for

SCHEMA = "id int, text string, unit string, kind int"
CLEAN = [
    "Les chébrinoraux pâles ont remplacé l’été passé à Lotaville",
    "Никто не видел, как быстрые фермы накрыли щиты, яpкиe",
    "દર અઠવાડિયે લોકોએ મોટું ગામ માં તપાસ્યું",
    "Die spröden Hämmer — für 5 € “neu” gezählt über Übermut",
]


def frames(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], SCHEMA)
    return df, spark.createDataFrame([(c,) for c in CLEAN], "text string")


def found(spark, texts):
    df, clean = frames(spark, texts)
    return {r.id for r in G.garbled_records(df, "id", "text", clean).collect()}


def test_every_chain_is_found_and_restored(spark):
    texts, want = [], []
    for clean in CLEAN:
        for chain in G.CHAINS:
            # whole texts that the chain changes without losing characters
            form = G.garble(clean, chain)
            if form and form != clean and G.LOST not in form and "\xa0" not in form and "\x85" not in form:
                texts.append(form)
                want.append(clean)
    assert len(texts) > 60
    df, clean = frames(spark, texts)
    restored = {r.id: r.restored for r in G.restored_records(df, "id", "text", clean).collect()}
    assert len(restored) >= 0.97 * len(texts)
    exact = sum(restored.get(i) == w for i, w in enumerate(want))
    wrong = [(t, restored.get(i), w) for i, (t, w) in enumerate(zip(texts, want, strict=True)) if restored.get(i) != w]
    assert exact >= 0.75 * len(texts), (exact, len(texts), wrong[:20])


def test_partly_garbled_and_lost(spark):
    g = lambda s, *c: G.garble(s, c)
    texts = [
        "plain " + g("été", "utf_8>cp1252") + " end",
        "plain word" + g("’", "utf_8>cp437") + "s end",
        "the nice (" + g("£", "utf_8>latin_1") + "5)",
        "a lost " + g("à", "utf_8>cp1252?").replace("\xa0", G.LOST),
        g("незнакомое слово", "utf_8>cp1251"),
    ]
    assert found(spark, texts) >= {0, 1, 3, 4}


def test_sound_texts(spark):
    texts = [
        "The sign showed the letter “Ã” above", "L’affiche portait « Ð » : à", "ÂGE ET CHÂTEAU", "25 °C № 4 they paid 40 € for the “set™”…",
        "НИКТО НЕ ВИДЕЛ", "Maß 48µ, Größe §90", None, "", "Тhе саfé", "ｆｕｌｌ", "лёд и ёлка", "fi­ts", "Прибор Р-62С и РС-40", "Нemoкpый лeд", "Яpкиe caды",
    ]
    assert found(spark, texts) == set()


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    _, clean = frames(spark, [])
    assert G.garbled_records(empty, "id", "text", clean).count() == 0
    long = "x" * 200_000 + G.garble("é", ("utf_8>cp1252",))
    df, _ = frames(spark, [long, long, "�"])
    assert {r.id for r in G.garbled_records(df.union(df), "id", "text", clean).collect()} == {0, 1, 2}
    none = clean.limit(0)
    assert {r.id for r in G.garbled_records(df, "id", "text", none).collect()} == {2}


@pytest.mark.parametrize("chain", [c for c in G.CHAINS if "?" not in "".join(c)])
def test_forms_come_from_their_chain(chain):
    for word in ("été", "быстрые", "ગામ"):
        form = G.garble(word, chain)
        if form is not None and G.LOST not in form:
            text = form
            for step in reversed(chain):
                written, read = step.split(">")
                data = G._encode(text, read)
                assert data is not None
                text = data.decode(written)
            assert text == word


def test_all_forms_at_once_hold_each_single_form():
    units = ["été", "быстрые", "ગામ", "’", "Übermut", "щиты", "5 €".replace(" ", ""), "àÂ", "x", "ё"]
    have = [set() for _ in units]
    for places, text in G.all_forms(units):
        for i, f in zip(places, text.split("\n"), strict=True):
            have[i].add(f)
    for i, unit in enumerate(units):
        for weak in (False, True):
            assert {f for f, _ in G.garbled_forms(unit, True, weak)} <= have[i]


def test_decoding_like_the_codecs():
    data = bytes(range(256))
    for encoding in {step.split(">")[1] for chain in G.CHAINS for step in chain}:
        want = data.decode(encoding.rstrip("?"), "replace")
        got = G._decode(data, encoding)
        assert all(a == b or (a == G.LOST and b == chr(k)) for k, (a, b) in enumerate(zip(want, got, strict=True)))
        assert encoding.endswith("?") or G.LOST not in got


def test_bit_set_keeps_all_members(spark):
    rows = spark.range(5000).selectExpr("concat('wört', id) AS unit")
    data, bits = G._wanted_bits(rows)
    have = np.frombuffer(data, np.uint8)

    def inside(lines):
        at = G._probes(G.line_hashes("\n".join(lines)), bits)
        return ((have[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1).all(axis=0)

    assert inside([f"wört{k}" for k in range(5000)]).all() and inside([f"word{k}" for k in range(20_000)]).mean() < 0.002
    assert bits_for(10**12) == 27 and len(bit_set(rows.limit(0), F.lit(1), 12)) == 512


def test_line_hashes_depend_on_the_line_only():
    lines = ["a", "", "ab", "ba", "été", "a" * 1000, "x", "a", ""]
    every = G.line_hashes("\n".join(lines))
    assert [int(h) for h in every] == [int(G.line_hashes(line)[0]) for line in lines] and len(set(every.tolist())) == 7
