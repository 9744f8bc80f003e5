import hashlib
import random
import re

import pytest

from tickloom.llm import common, decontam

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def slow(docs, items, n=10):
    out = {}
    for k, (i, t) in enumerate(docs):
        w = words(t)
        hit, ids = set(), set()
        for item, text in items:
            v = words(text)
            size = min(n, len(v))
            for a in range(len(v) - size + 1) if v else ():
                for b in range(len(w) - size + 1):
                    if w[b : b + size] == v[a : a + size]:
                        hit |= set(range(b, b + size))
                        ids.add("" if item is None else str(item))
        out[k] = (i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return sorted(out.values(), key=str)


def case(seed=1):
    rnd = random.Random(seed)
    items = [(k, " ".join(rnd.choices(["a", "b", "Cé", "d9"], k=rnd.choice([2, 5, 12, 15])))) for k in range(12)] + [(None, "q w e r"), (50, None), (51, "!!"), (3, "zz yy")]
    docs = []
    for k in range(40):
        parts = [" ".join(rnd.choices(["a", "b", "cÉ", "d9", "x"], k=rnd.randint(0, 30)))]
        if rnd.random() < 0.6:
            text = rnd.choice(items)[1] or ""
            parts.insert(rnd.randint(0, 1), text.upper().replace(" ", ", ") if rnd.random() < 0.5 else text)
        docs.append((k % 35, " ".join(parts)))
    return [*docs, (100, None), (101, ""), (102, "..."), (103, "a " * 5000)], items


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 1])
def test_equals_brute_force(spark, block_bytes):
    docs, items = case()
    found = decontam.contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), block_bytes=block_bytes)
    assert sorted((tuple(r) for r in found.collect()), key=str) == slow(docs, items)


def test_dropping_and_cutting(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda."
    docs = spark.createDataFrame([(1, f"Before. {item.upper()} After!", "x"), (2, "nothing here", "y"), (3, None, "z"), (3, None, "z")], DOCS + ", hits string")
    items = spark.createDataFrame([(7, item)], ITEMS)
    for size in (decontam.BLOCK_BYTES, 1):
        kept = decontam.drop_contaminated(docs, items, block_bytes=size)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 3]
        cut = decontam.drop_contaminated(docs, items, block_bytes=size, spans_only=True)
        assert {r.doc_id: r.text for r in cut.collect()} == {1: "Before. . After!", 2: "nothing here", 3: None}


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 1])
def test_edges(spark, block_bytes):
    """Null texts and items, long texts, repeated rows and clashing columns, in either layout."""
    docs, items = spark.createDataFrame([(1, "a b c")], DOCS), spark.createDataFrame([(1, "a b c")], ITEMS)
    none = spark.createDataFrame([], ITEMS)
    assert decontam.contamination(spark.createDataFrame([], DOCS), items, block_bytes=block_bytes).collect() == []
    assert [(r.n_words, r.n_hit) for r in decontam.contamination(docs, none, block_bytes=block_bytes).collect()] == [(3, 0)]
    assert [(r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(docs, items, block_bytes=block_bytes).collect()] == [(3, 3, 1)]
    rows = [(None, None, 1), (2, "x " * 50_000 + "a b c", 2), (2, "x " * 50_000 + "a b c", 2), (None, "a b", 3), (5, "", 4)]
    docs = spark.createDataFrame(rows, DOCS + ", hits int").withColumnRenamed("hits", "row")
    items = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None), (None, "a b"), (7, "...")], ITEMS)
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(docs, items, block_bytes=block_bytes).collect()))
    assert got == [(0, 0, 0, 0), (0, 2, 2, 1), (2, 50_003, 3, 2), (2, 50_003, 3, 2), (5, 0, 0, 0)]
    kept = decontam.drop_contaminated(docs, items, block_bytes=block_bytes)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (5, "")]


def test_table_of_bits_follows_the_windows():
    assert common.table_bits(0) == 16 and common.table_bits(1 << 20) == 25 and common.table_bits(1 << 40) == common.TABLE_BITS
