"""Nulls in every column, repeated rows and clashing column names, for all operators at once."""

import pytest

from lexmill.llm import catalogue
from lexmill.llm import sizes as S

pytestmark = pytest.mark.skipif(not S.default_vocabulary_exists(), reason="no tokenizer files")
LONG = "word " * 30_000 + "é"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with a null in each column in turn, and an all-null row."""
    place = tmp_path_factory.mktemp("edges")
    full = {
        "items": ("id int, sentence_a string, sentence_b string, uncertainty double, status string, gold_label double, text string, field string", [(1, "Ã©tÃ© passé", "été  passé", 0.1, "gold", 1.0, "x", "y"), (2, "été passé", "été passé", 0.1, "gold", 1.0, "x", "y"), (3, LONG, LONG, 0.1, "gold", 1.0, "x", "y"), (4, "(été) passé", "x", 0.1, "gold", 1.0, "x", "y"), (5, "été passé.", "X", 0.1, "gold", 1.0, "x", "y")]),
        "annotators": ("id int, name string, reliability double, label double", [(k, "n", 1.0, 2.0) for k in range(1, 5)]),
        "annotations": ("id int, item_id int, annotator_id int, label double, created_at timestamp, item int", None),
        "en_sts_test": ("test_id int, sentence_a string, sentence_b string, score int, id int", [(1, "one two three four five six seven eight nine", "b", 3, 1)]),
        "documents": ("doc_id long, text string, lang string, source string, n_chars long, raw_path string, id string, h int", [(1, "one two three four five six seven eight nine " * 6, "en", "Web Crawl", 9, "p", "q", 1), (2, LONG, "en", "web_crawl", 9, "p", "q", 1), (4, "one two three four five six seven eight nine " * 6, "en", "web_crawl", 9, "p", "q", 1)]),
        "source_targets": ("source string, target_share double, max_repeats int, documents int", [("web_crawl", 0.6, 2, 1), ("none", 0.4, 1, 1)]),
        "seq_limits": ("stage string, max_seq_length int, capacity int", [("s", 64, 1)]),
    }
    import datetime as dt

    full["annotations"] = (full["annotations"][0], [(10 * i + a, i, a, float(i), dt.datetime(2025, 1, 1), 5) for i in range(1, 5) for a in range(1, 5)])
    for name, (schema, rows) in full.items():
        extra = [(None,) * len(rows[0])]
        if name not in ("source_targets", "seq_limits"):
            extra += [tuple(None if j == k else v for j, v in enumerate(rows[0])) for k in range(len(rows[0]))]
        spark.createDataFrame(rows + extra + rows[:1] * 3, schema).write.parquet(f"{place}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{place}/empty/{name}.parquet")
    return str(place)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_nulls_repeats_and_clashes(spark, folder, name):
    rows = catalogue.QUERIES[name](spark, folder).collect()
    assert rows
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows) and all(v is not None for r in rows for v in r)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_empty_tables(spark, folder, name):
    assert catalogue.QUERIES[name](spark, f"{folder}/empty").count() == 0
