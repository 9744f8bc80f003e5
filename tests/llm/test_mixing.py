from fractions import Fraction
from math import floor

import pytest

from tickloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def check(rows, got):
    words = lambda t: len((t or "").split())
    by = {}
    for _, t, s in rows:
        by[s] = by.get(s, 0) + words(t)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([by[s] for s in order]), strict=True))
    taken = {s: 0 for s in by}
    for r in got:
        assert r["source_size"] == by[r.source] and abs(r.target - float(goal[r.source])) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert taken == {s: floor(goal[s]) for s in by}


def test_targets():
    assert mixing.targets([10, 10, 10]) == [20, Fraction(25, 3), Fraction(50, 3)]
    assert sum(mixing.targets([1000, 1, 1])) == 1503 and mixing.targets([1000, 1, 1])[1:] == [2, 2]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    assert mixing.targets([0, 8]) == [0, 12]


def test_budgets_are_exact(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    check(rows, got)
    again = mixing.mix(docs.repartition(7)).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}


def test_one_hot_source(spark):
    rows = [(k, "w " * (k % 5 + 1), "hot" if k % 3 else f"s{k % 9}") for k in range(900)]
    check(rows, mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect())


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(None, "a b c", "x"), (1, "", None), (1, "b", None), (1, "b", None)], [(1, "a " * 9000, "x"), (2, "b", "y")]])
def test_edges(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", key int, target int")
    check(rows, mixing.mix(docs).collect())
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    check_copies(rows, mixing.mix(docs).collect(), out.collect())


def check_copies(rows, mixed, out):
    """As many rows of each id, source and size as the mix takes whole documents of."""
    size = lambda t: len((t or "").split())
    want, got = {}, {}
    for r in mixed:
        key = (r.doc_id, r.source, r["size"])
        want[key] = want.get(key, 0) + (floor(r.taken / r["size"] + 0.5) if r["size"] else 1)
    for r in out:
        key = (r.doc_id, r.source, size(r.text))
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    assert {(r.doc_id, r.text, r.source) for r in out} <= set(rows)


def test_rows_that_share_an_id_have_times_of_their_own(spark):
    """One id and null ids over several texts and sources, repeated rows, and rows that the mix can't tell apart."""
    rows = [(7, "a b c d", "x"), (7, "e f", "x"), (7, "g h", "y"), (None, "i j k", "y"), (None, "l m n", "y"), (None, None, None), (8, "o p q r", "x"), (8, "s t u v", "x"), (8, "s t u v", "x")] + [(k, "w " * (k % 6), "xyz"[k % 3]) for k in range(20, 60)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", size int")
    check_copies(rows, mixing.mix(docs).collect(), mixing.apply_mix(docs).collect())


def test_copies(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "ab"[k % 2]) for k in range(400)], SCHEMA)
    n = mixing.apply_mix(docs).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in n} == {"a": 400, "b": 200}
