import numpy as np
import pytest

from lexiweave.llm.mixing import Plan, count_tokens, fill, invert, mix_sources, token_counter

T = "source string, target_share double, max_repeats int"


def docs(spark, sizes, n=7):
    rows = [(1000 * i + j, s, n, "x") for i, (s, k) in enumerate(sizes.items()) for j in range(k)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, position string").repartition(5)


def test_shares_repeats_and_positions(spark):
    d = docs(spark, {"a": 500, " B": 100, "c": 10, None: 20, "other": 30})
    t = spark.createDataFrame([("A", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("missing", 0.0, 1), (None, 0.1, 1)], T)
    m = mix_sources(d, t)
    rep = {r.source: r for r in m.report.collect()}
    whole = 660 * 7
    c = 10 * 4 * 7
    assert rep["c"].mix_tokens == c and rep["c"].max_repeat == 4 and rep["c"].target_share == pytest.approx(0.2)
    assert abs(rep["a"].mix_tokens - (whole - c) * 5 / 8) <= 7 and abs(rep["b"].mix_tokens - (whole - c) * 3 / 8) <= 7
    assert rep[""].mix_tokens == 0 and rep[""].n_tokens == 140 and rep["other"].target_share == 0 and rep["missing"].n_documents == 0
    assert sum(r.actual_share for r in rep.values()) == pytest.approx(1)
    rows = m.rows.collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.repeat, r.position))
    assert all(0 <= r.position <= 1 for r in rows)
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) and sorted(v, key=lambda x: x[1]) == sorted(v) for v in by.values())
    assert max(len(v) for k, v in by.items() if k < 1000) == 1
    early = sum(r.n_tokens for r in rows if r.position < 0.5 and r.source == "a") / rep["a"].mix_tokens
    assert early > 0.53  # the source that may not be repeated comes rather early
    assert sum(r.n_tokens for r in rows if r.position < 0.5) == pytest.approx(whole / 2, rel=0.03)


def test_positions_follow_the_schedule(spark):
    d = docs(spark, {"a": 1000})
    m = mix_sources(d, spark.createDataFrame([("a", 1.0, 1)], T), schedules={"a": [(0.0, 0.0), (0.5, 2.0), (1.0, 0.0)]})
    p = np.sort([r.position for r in m.rows.collect()])
    want = lambda t: 2 * t * t if t < 0.5 else 1 - 2 * (1 - t) ** 2
    assert max(abs((p < t).mean() - want(t)) for t in np.linspace(0, 1, 21)) < 0.005


def test_invert():
    knots = [(0.0, 1.0), (0.3, 0.0), (0.6, 0.0), (1.0, 3.0)]
    t = np.linspace(0, 1, 2001)
    w = np.interp(t, [k[0] for k in knots], [k[1] for k in knots])
    area = np.concatenate([[0], ((w[1:] + w[:-1]) / 2 * np.diff(t)).cumsum()])
    d = np.linspace(0, 0.999, 50)
    assert np.allclose(np.interp(invert(knots, d), t, area / area[-1]), d, atol=1e-3)
    assert np.allclose(invert([(0.0, 2.0), (1.0, 2.0)], d), d)


def test_fill():
    p = {"a": Plan(0.5, 1, 100), "b": Plan(0.5, 1, 10_000), "c": Plan(0.0, 5, 10)}
    fill(p, 1000.0)
    assert (p["a"].wanted, p["b"].wanted, p["c"].wanted) == (100, 900, 0)
    fill(p, 1e9)
    assert (p["a"].wanted, p["b"].wanted) == (100, 10_000)


def test_repeated_rows_are_documents_of_their_own(spark):
    d = docs(spark, {"a": 50, "b": 5})
    m = mix_sources(d.unionAll(d), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], T))
    rep = {r.source: r for r in m.report.collect()}
    assert rep["a"].n_documents == 100 and rep["b"].mix_tokens == 2 * 10 * 7 and rep["b"].max_repeat == 2
    assert m.rows.filter("source = 'a'").count() <= 100


def test_empty_and_zero(spark):
    t = spark.createDataFrame([("a", 0.5, 1)], T)
    m = mix_sources(docs(spark, {}), t)
    assert m.rows.count() == 0 and [r.source for r in m.report.collect()] == ["a"]
    m = mix_sources(docs(spark, {"a": 3}, n=0), t)
    assert m.rows.count() == 0
    m = mix_sources(docs(spark, {"a": 3}), t.limit(0))
    assert m.rows.count() == 0 and m.report.first().n_documents == 3


def test_token_counts(spark):
    texts = ["Ala ma kota", "", None, "<|endoftext|> zażółć " * 50]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    ranks = {r.i: r.n_tokens for r in count_tokens(d, "text", "/opt/tokenizers/byte_bpe_50k.tiktoken").collect()}
    assert ranks[1] == ranks[2] == 0 and ranks[0] == 4 or ranks[0] > 2
    assert [ranks[0], ranks[3]] == token_counter("/opt/tokenizers/byte_bpe_50k.json")([texts[0], texts[3]])


def test_a_partly_repeated_source(spark):
    """Of a source wanted one and a half times, half the documents come twice; no other repeat is made."""
    d = docs(spark, {"a": 100, "b": 40})
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 9)], T)
    m = mix_sources(d, t, total_tokens=120 * 7)
    n = {}
    for r in m.rows.filter("source = 'b'").collect():
        n[r.doc_id] = max(n.get(r.doc_id, 0), r.repeat)
    assert sorted(n.values()) == [1] * 20 + [2] * 20 and m.rows.filter("source = 'a'").count() == 60
