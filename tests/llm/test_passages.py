"""Repeated passages that start and end inside lines."""

import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from plotweave.llm.common import TIDY, staged
from plotweave.llm.winnow import dedup_lines, repeated_lines, repeated_passages
from tests.llm import brute


def passages(docs, least=50):
    """key -> numbers of words to remove: those of windows that occur earlier."""
    seen, gone = set(), {}
    for key in sorted(docs):
        w = brute.words(docs[key])
        gone[key] = set()
        for i in range(len(w) - least + 1):
            window = tuple(w[i:i + least])
            if window in seen:
                gone[key] |= set(range(i, i + least))
            seen.add(window)
    return gone


def test_passage_inside_lines(llm):
    """60 words put mid-line, over line ends set elsewhere, at both ends of a text, and with one word too few."""
    words = [f"p{i}" for i in range(60)]
    run = " ".join(words)
    wrapped = " ".join(words[:25]) + "\n" + " ".join(words[25:])
    texts = {1: f"first {run} end", 2: f"other text {wrapped} goes on\nlast  line ", 3: f"{run} tail\nx", 4: f"head\nstart  {run}", 5: " ".join(words[11:]),
             6: run, 7: f"a\n \n{run}\n b", 8: "wide " * 300, 9: f"x {' '.join(words[:50])}\ny {' '.join(words[5:])} z", 10: None, 11: f"u\n{run} v\n"}
    df = llm.createDataFrame([*texts.items(), (9, texts[9]), (None, f"no id {run}")], "doc_id BIGINT, text STRING")
    got = {r.doc_id: r for r in repeated_passages(df).collect()}
    assert set(got) == {1, 2, 3, 4, 6, 7, 8, 9, 11} and all(got[i].n_words == 60 for i in (1, 2, 3, 4, 6, 7, 11))
    want = passages({(0 if d is None else d): t for d, t in [(None, f"no id {run}"), *texts.items()]})
    assert {d: {j for x in r.passages for j in range(x.a, x.b + 1)} for d, r in got.items()} == {d: x for d, x in want.items() if x}
    rows = dedup_lines(df).collect()
    left = {r.doc_id: r.text for r in rows}
    assert len(rows) == len(texts) + 2 and left[None] == f"no id {run}" and left[5] == texts[5] and left[10] is None
    assert left[1] == "first end" and left[2] == "other text goes on\nlast  line " and left[3] == "tail\nx" and left[4] == "head\nstart"
    assert left[6] == "" and left[7] == "a\n \n b" and left[8] == "wide " and left[9] == "x\ny z" and left[11] == "u\nv\n"


@pytest.mark.parametrize("least", [5, 50])
def test_passages_against_brute_force(llm, sf, texts, docs, least):
    texts = texts if least == 50 else {d: t for d, t in texts.items() if d < 60}
    got = {r.doc_id: {j for x in r.passages for j in range(x.a, x.b + 1)} for r in repeated_passages(
        docs.where(f"doc_id <= {max(texts)}"), least_words=least).collect()}
    assert got and got == {d: x for d, x in passages(texts, least).items() if x}


def test_query_reports_passages(llm, sf, texts):
    rows = entry_points.queries()["op7_winnow_lines"](llm, sf).collect()
    want = passages(texts)
    assert {r.doc_id: r.n_passage_words for r in rows} == {d: len(x) for d, x in want.items()}
    assert all(r.n_passage_words >= r.n_removed_words for r in rows) and any(r.n_passage_words > r.n_removed_words for r in rows)


def test_blanks_of_every_kind(llm):
    """Runs and passages do not depend on which blanks stand between words."""
    lines = [" ".join(f"b{i}w{j}" for j in range(30)) for i in range(3)]
    odd = ["\t" + lines[0].replace(" ", "\x0b "), lines[1].replace(" ", "\x0c\t\r") + " \r", "  " + lines[2].replace(" ", "   ") + "\t"]
    texts = {1: "\n".join(lines), 2: "\n \t\n".join(odd), 3: "x y " + lines[0].replace(" ", " ")}
    df = llm.createDataFrame(list(texts.items()), "doc_id BIGINT, text STRING")
    want = brute.repeated_lines(texts)
    assert {r.doc_id: r.lines for r in repeated_lines(df).collect()} == want and want[2] == [0, 2, 4]
    assert {r.doc_id: r.n_words for r in repeated_passages(df).collect()} == {2: 90}


def test_staged_steps_leave_no_shuffle_files(llm):
    """Shuffle files go with the step that wrote them; before, they piled up until the driver collected its garbage."""
    store = llm._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = store.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffled()
    rows = staged(llm.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "tidy")
    deadline = time.monotonic() + 20
    while shuffled() - before and time.monotonic() < deadline:
        time.sleep(0.1)
    assert not shuffled() - before and rows.count() == 7 and llm.conf.get(TIDY) == "false"
