import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from tickloom.llm import near

SCHEMA = "doc_id long, text string"


def grams(text):
    w = (text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}


def slow(rows):
    """Smallest id of the component of each row, by all pairs."""
    sets = {k: grams(t) for k, t in rows}
    root = {k: k for k in sets}
    for a, b in combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    return root


def changed(rnd, words, n):
    """words with the last word replaced and n more words appended: similarity falls with n."""
    return words[:-1] + [f"new{rnd.random()}" for _ in range(n + 1)]


def test_planted_copies_from_080_to_095_go(spark):
    rnd = random.Random(4)
    rows, planted = [], []
    common = [f"b{k}" for k in range(30)]
    for k in range(40):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(120, 400))] + common
        rows.append((k, " ".join(words)))
        copy = changed(rnd, words, rnd.randint(0, len(words) // 4))
        rows.append((100 + k, " ".join(copy)))
        one, two = grams(rows[-2][1]), grams(rows[-1][1])
        planted.append((len(one & two) / len(one | two), 100 + k))
    rows += [(500, None), (501, " "), (502, "a b"), (503, "a b"), (504, "a c")]
    assert sum(0.8 <= j < 0.95 for j, _ in planted) > 20 and any(j < 0.8 for j, _ in planted)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert [k for j, k in planted if (j >= 0.8) == (k in kept)] == []
    assert kept == set(slow(rows).values())


@pytest.mark.parametrize("often", [1, near.OFTEN])
def test_equals_all_pairs(spark, monkeypatch, often):
    """Chains, clusters and shared wording, with any order of the shingles."""
    monkeypatch.setattr(near, "OFTEN", often)
    monkeypatch.setattr(near, "SAMPLE", 2)
    monkeypatch.setattr(near, "CELLS", 64)
    rnd = random.Random(9)
    base = [[f"w{rnd.randrange(40)}" for _ in range(rnd.randint(10, 60))] for _ in range(8)]
    rows = []
    for k in range(150):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = f"v{rnd.randrange(6)}"
        rows.append((k, " ".join(words + [f"t{rnd.randrange(3)}"] * rnd.randint(0, 2))))
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = slow(rows)
    assert got == want and 8 < len(set(want.values())) < 150


def test_edges(spark):
    assert near.keep_first(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "x y"), (3, "x y"), (3, "x y"), (4, "z")]
    assert [tuple(r) for r in near.keep_first(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()] == [(3, "x y"), (4, "z")]
    rows = [(None, "q r"), (None, "q r"), (3, "x y")]
    assert sorted((r.doc_id or 0, r.text) for r in near.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()) == [(0, "q r"), (3, "x y")]


def test_rows_with_null_and_repeated_ids_stay(spark):
    """Distinct texts stay whatever their ids, next to columns with the operator's own names and a map."""
    rows = [(None, "p q r s t u"), (None, "k l m n o p"), (7, "aa bb cc dd ee"), (7, "ff gg hh ii jj"), (8, "vv ww xx yy zz"), (9, None), (None, " ")]
    docs = spark.createDataFrame([(*r, 1, 2, {"k": 3}) for r in rows * 2], SCHEMA + ", set_id int, root int, m map<string, int>")
    got = near.keep_first(docs)
    assert got.columns == docs.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(rows[:-1], key=str)


@pytest.mark.parametrize("block", [3, 40])
def test_a_shingle_of_many_sets_is_dealt_in_blocks(spark, monkeypatch, block):
    """One component of near copies and many single texts, all with one common passage in their prefixes."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "OFTEN", 10**9)
    rnd = random.Random(1)
    passage = [f"p{k}" for k in range(30)]
    rows = [(k, " ".join([f"o{k}x{j}" for j in range(rnd.randint(3, 9))] + passage)) for k in range(80)] + [(100 + k, " ".join(passage + [f"e{k}"])) for k in range(30)]
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == slow(rows)


def test_a_shingle_of_many_sets_hands_on_few_pairs(spark, monkeypatch):
    """Texts with one common passage, most of them not similar, and some copies: before, each two of them were a row (some 80,000)."""
    monkeypatch.setattr(near, "OFTEN", 10**9)
    rnd = random.Random(2)
    passage = [f"p{k}" for k in range(30)]
    rows = [(k, " ".join([f"o{k}x{j}" for j in range(12)] + passage)) for k in range(400)]
    for k in range(40):
        words = rows[rnd.randrange(400)][1].split()
        rows.append((1000 + k, " ".join(words[: -rnd.randint(1, 6)] + [f"e{k}"])))
    made = []

    def counted(df, scan, schema, plain=type(spark.range(1)).mapInArrow):
        total = spark.sparkContext.accumulator(0)
        made.append((schema, total))

        def wrapped(batches):
            for batch in scan(batches):
                total.add(batch.num_rows)
                yield batch

        return plain(df, wrapped, schema)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", counted)
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == slow(rows) and 300 < len(set(got.values())) < 440
    assert 0 < sum(total.value for schema, total in made if schema.startswith("a long, b long")) < 32 * len(rows)


@pytest.mark.parametrize("rounds, cells", [(0, 1 << 18), (6, 64)])
def test_sketches_lose_no_pair(spark, monkeypatch, rounds, cells):
    """Sets of many sizes that meet by sketches only, of equal length or folded, with and without the rounds of closest pairs."""
    for name, value in {"OFTEN": 10**9, "LIGHT": 1, "WORDS": 1, "BLOCK": 20, "ROUNDS": rounds, "CELLS": cells}.items():
        monkeypatch.setattr(near, name, value, raising=False)
    rnd = random.Random(5)
    base = [[f"w{b}x{rnd.randrange(3000)}" for _ in range(n)] for b, n in enumerate((12, 30, 90, 300))]
    rows = []
    for k in range(160):
        words = list(base[k % 4])
        for _ in range(rnd.randint(0, 1 + len(words) // 30)):
            words[rnd.randrange(len(words))] = f"v{rnd.randrange(9)}"
        rows.append((k, " ".join(words[: len(words) - rnd.randint(0, len(words) // 6)])))
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == slow(rows) and 4 < len(set(got.values())) < 160


def test_sketches_differ_in_no_more_than_their_sets():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 287, 288, 350, 5000):
        one = np.unique(rnd.integers(-(2**63), 2**63 - 1, n))
        two = np.unique(np.concatenate([one[: n - n // 10], rnd.integers(-(2**63), 2**63 - 1, n // 12)]))
        a, b = (np.frombuffer(near.sketch(x), np.uint64) for x in (one, two))
        while len(a) != len(b):
            a, b = (x if len(x) == min(len(a), len(b)) else np.bitwise_xor(*x.reshape(2, -1)) for x in (a, b))
        apart, really = int(np.bitwise_count(a ^ b).sum()), len(np.setxor1d(one, two))
        assert 0.9 * really - 2 <= apart <= really
