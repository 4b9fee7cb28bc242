"""Training-data queries with SQL next to them, and queries held against brute force."""

import math
from collections import Counter
from zlib import crc32

import pytest

import __spark_entry__ as entry_points
from check_oracle import compare, open_oracle
from tests.llm import brute

SQL = sorted(set(entry_points.LLM_QUERIES) & set(entry_points.oracle_sql()))


@pytest.mark.parametrize("name", SQL)
def test_query_agrees_with_sql(llm, sf, name):
    con = open_oracle(sf)
    assert compare(llm, con, name, sf) == ""
    con.close()


def test_all_operators_are_registered():
    numbers = Counter(name.split("_")[0] for name in entry_points.LLM_QUERIES)
    assert numbers == Counter([*[f"op{n}" for n in range(1, 14)], "pipeline"])


@pytest.mark.parametrize("name, find, kinds", [
    ("op1_personal_data", brute.personal, ("email", "ip", "card", "phone")),
    ("op10_markov_secrets", brute.secrets, ("assign", "access", "hex")),
])
def test_base_spans(llm, sf, texts, name, find, kinds):
    rows = entry_points.queries()[name](llm, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = find(texts[r.doc_id])
        assert r.base_sha256 == brute.sha(base)
        assert [r[f"n_{k}"] for k in kinds] == [sum(b[0] == k for b in base) for k in kinds]
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(","))


def test_line_runs(llm, sf, texts):
    rows = entry_points.queries()["op7_winnow_lines"](llm, sf).collect()
    want = brute.repeated_lines(texts)
    assert {r.doc_id: r.removed_lines for r in rows} == {d: ",".join(map(str, x)) for d, x in want.items()}
    assert any(want.values())


def test_quality_of_held_out_labels(llm, sf):
    """At this size a few dozen labels train and test; most of them have to come out right."""
    rows = entry_points.queries()["op5_quality_network"](llm, sf).collect()
    labels = {r.doc_id: r.quality for r in llm.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == (1 if r.score >= 0.3 else 0)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == q for p, q in held) >= 0.8 * len(held)


def test_toxicity_of_labels(llm, sf):
    rows = {r.doc_id: r for r in entry_points.queries()["op8_toxicity_chain"](llm, sf).collect()}
    labels = {r.doc_id: r.toxic for r in llm.read.parquet(f"{sf}/labels.parquet").collect()}
    right = [rows[d].toxic == bool(x) for d, x in labels.items() if d in rows]
    assert sum(right) >= 0.9 * len(right)
    assert all(0 <= p <= 1 for r in rows.values() for p in (r.p_severe, r.p_mild, r.p_toxic))


def test_every_exact_benchmark_passage_is_found(llm, sf, texts):
    got = {(r.doc_id, r.item_id) for r in entry_points.queries()["op6_benchmark_hits"](llm, sf).collect()}
    items = {r.item_id: r.text for r in llm.read.parquet(f"{sf}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in texts.items() for i, b in items.items() if b in t}
    assert exact and exact <= got and len(got) <= 1.2 * len(exact)


def test_mix_meets_targets(llm, sf):
    rows = entry_points.queries()["op2_mix_sources"](llm, sf).collect()
    again = entry_points.queries()["op2_mix_sources"](llm, sf).collect()
    assert sorted(rows) == sorted(again)
    sources = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        sources.setdefault((r.target, r.source_size), []).append(r)
    assert math.isclose(sum(t for t, _ in sources), sum(r["size"] for r in rows))
    for (target, _), own in sources.items():
        assert abs(sum(r.taken for r in own) - target) <= max(r["size"] for r in own)
