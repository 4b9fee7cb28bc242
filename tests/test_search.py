"""Name and label search against comparing everything with everything."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plotweave.operators import catalog, search

PLACE = "place_id BIGINT, place_rank INT, name STRING, country STRING"


def found(spark, tmp_path, places, queries, hot_rows=search.HOT_ROWS, **settings):
    path = str(tmp_path / "index")
    search.build_index(spark.createDataFrame(places, PLACE), path, **settings)
    asked = spark.createDataFrame(queries, "query_id BIGINT, query STRING")
    rows = search.gazetteer_search(asked, path, hot_rows).select("query_id", "edits", "other_words", "place_rank", "place_id").collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("hot_rows", [2, search.HOT_ROWS])
def test_misspelt_and_partial_names(spark, tmp_path, hot_rows):
    places = [(1, 0, "New York", "us"), (2, 1, "York", "us"), (3, 0, "Newark", "us"), (4, 0, "New  YORK", "ca"), (5, 2, " new york ", "us"),
              (6, 0, None, "us"), (7, 0, " ", "us"), (8, 0, "Ann", "us")]
    queries = [(1, "yrok"), (2, "new yorc"), (3, "york NEW"), (4, "york"), (5, "nwark"), (6, "an"), (7, " "), (8, None), (9, "x" * 5000), (10, "york york")]
    none = (None,) * 4
    assert found(spark, tmp_path, places, queries, hot_rows) == sorted([
        (1, *none), (2, 1, 0, 0, 1), (2, 1, 0, 2, 5), (3, 0, 0, 0, 1), (3, 0, 0, 2, 5), (4, 0, 0, 1, 2), (4, 0, 1, 0, 1), (4, 0, 1, 2, 5),
        (5, 1, 0, 0, 3), (6, *none), (9, *none), (10, 0, -1, 1, 2), (10, 0, 0, 0, 1), (10, 0, 0, 2, 5)], key=repr)


def test_only_the_best_and_empty_tables(spark, tmp_path):
    places = [(i, i % 3, f"Springfield {'abc'[i % 3]}", "us") for i in range(30)]
    assert found(spark, tmp_path, places, [(1, "springfeld")], n=2) == [(1, 1, 1, 0, 0), (1, 1, 1, 0, 3)]
    assert found(spark, tmp_path, [], [(1, "springfield")]) == [(1, None, None, None, None)]
    assert found(spark, tmp_path, places, []) == []


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_similar_words_equal_all_distances(spark, edits):
    dice = random.Random(edits)
    words = sorted({"".join(dice.choices("abc", k=dice.randint(1, 9))) for _ in range(150)} | {"a" * 64, "a" * 63 + "b", "a" * 65, "a" * 66})
    forms = spark.createDataFrame([(w,) for w in words], "word STRING").select(
        "word", F.lit(1).alias("_names"), F.explode(search._forms(F.col("word"), search.SHORTEST - edits, search.LONGEST + edits, edits)).alias("_form"))
    asked = spark.createDataFrame([(w,) for w in words], "asked STRING")
    got = {(r.asked, r.word) for r in search.similar_words(asked, forms, edits).collect()}
    allowed = lambda a: edits if search.SHORTEST <= len(a) <= search.LONGEST else 0
    assert got == {(a, b) for a, b in itertools.product(words, words) if abs(len(a) - len(b)) <= edits and levenshtein(a, b) <= allowed(a)}


def test_label_index_equals_the_scan(spark, tmp_path):
    rows = [("h1", "al", "Town", "Map 1.pdf"), ("h1", "al", "Town", "Map 1.pdf"), (None, "al", "Town", "b"), ("h2", "ca", "\u00c4lv", "a" * 3000), ("h3", None, None, "x")]
    documents = spark.createDataFrame(rows, "hash STRING, state STRING, city STRING, name STRING")
    path = str(tmp_path / "index")
    search.build_label_index(documents, path)
    queries = ["", " ", "town", "TOWN/map 1", "a", "/t", "\u00e4lv/aaa", "a" * 2999, "a" * 3001, "zz", "zzz", "x", "own/b", "town"]
    asked = spark.createDataFrame([*enumerate(queries), (99, None)], "query_id INT, query STRING")
    got = sorted(map(str, (tuple(r) for r in search.label_search(asked, path).select("query_id", "hash", "label").collect())))
    scan = lambda q: catalog.catalog_search(documents, q).select("hash", "label").collect()
    assert got == sorted(str((i, *r)) for i, q in enumerate(queries) for r in scan(q))
    search.build_label_index(documents.limit(0), path)
    assert search.label_search(asked, path).count() == 0


def test_labels_of_short_texts_are_found_without_candidates(spark, tmp_path):
    """Numbers share their last digits; what is looked up must not grow with texts times labels."""
    rows = [("h", "al", "s", f"{n}.pdf") for n in range(1000, 3000)]
    path = str(tmp_path / "index")
    search.build_label_index(spark.createDataFrame(rows, "hash STRING, state STRING, city STRING, name STRING"), path)
    texts = [f"{n}." for n in range(1000, 3000)] + [f"/{n}.pdf" for n in range(1000, 3000)] + ["x"]
    found = search.label_candidates(spark.createDataFrame([(t,) for t in texts], "_text STRING"), path)
    assert found.count() == 4000


def test_a_common_text_that_many_ask_for_is_many_tasks_work(spark, tmp_path):
    """20,000 labels hold what 200 queries ask for; no task makes all four million rows."""
    rows = spark.range(20_000).select(F.lit("h").alias("hash"), F.lit("es").alias("state"), F.lit("s").alias("city"), F.concat("id", F.lit(".pdf")).alias("name"))
    path = str(tmp_path / "index")
    search.build_label_index(rows, path)
    asked = spark.range(200).select(F.col("id").alias("query_id"), F.lit("s/").alias("query"))
    counts = [r["count"] for r in search.label_search(asked, path).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 4_000_000 and max(counts) < 4_000_000


def test_an_index_of_labels_has_a_row_a_character(spark, tmp_path):
    """Not one for each of the hundred substrings of a label; repeated and null queries keep their rows all the same."""
    documents = spark.createDataFrame([("h", "al", "s", f"{n}.pdf") for n in range(1000, 1500)], "hash STRING, state STRING, city STRING, name STRING")
    path = str(tmp_path / "index")
    search.build_label_index(documents, path)
    assert spark.read.parquet(f"{path}/postings").count() <= 500 * (len("al/s/1000.pdf") + 1)
    asked = spark.createDataFrame([(1, "1000"), (1, "1000"), (None, "1000"), (2, " 1000.PDF"), (3, "l"), (4, None)], "query_id INT, query STRING")
    found = search.label_search(asked, path)
    assert found.columns == [*documents.columns, "label", "query_id"]
    counts = {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()}
    assert counts == {1: 2, None: 1, 2: 1, 3: 500}
    assert search.label_search(asked.limit(0), path).count() == 0
