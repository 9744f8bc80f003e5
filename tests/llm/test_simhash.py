import random

import numpy as np
import pytest
import xxhash

from tickloom.llm import simhash

WORDS = [f"w{k}" for k in range(400)]


def slow_fingerprint(text, shingle=4):
    found = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[k : k + shingle]) for k in range(max(1, len(found) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def corpus():
    rnd = random.Random(5)
    rows, n = [], 0
    for _ in range(60):
        base = rnd.choices(WORDS, k=rnd.choice([3, 12, 80, 400]))
        for _ in range(rnd.choice([1, 1, 3, 8])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                copy[rnd.randrange(len(copy))] = rnd.choice(WORDS)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "ÄB  x"), (n + 4, "a" * 100_000)]
    return rows


def test_fingerprint_equals_the_slow_one():
    for _, text in corpus():
        assert simhash.fingerprint(simhash.hashes(text)) % 2**64 == slow_fingerprint(text)
    text = "Über alles A B c\x0bd\x85e " * 50
    assert simhash.fingerprint(simhash.hashes(text)) % 2**64 == slow_fingerprint(text)


def test_anchors_cover():
    anchors = simhash.Anchors(4)
    x = np.random.default_rng(1).integers(0, 1 << 22, 2000)
    row, anchor, beyond = anchors.near(x)
    home = beyond == 0
    assert (np.bincount(row[home], minlength=len(x)) == 1).all()
    assert (anchors.syndrome(anchor) == 0).all()
    assert (np.bitwise_count(x[row] ^ anchor) <= 4).all()
    near = x ^ (1 << np.random.default_rng(2).integers(0, 22, 2000))
    r2, a2, _ = anchors.near(near)
    at = set(zip(r2.tolist(), a2.tolist(), strict=True))
    assert all((r, a) in at for r, a, h in zip(row.tolist(), anchor.tolist(), home.tolist(), strict=True) if h)


@pytest.mark.parametrize("threshold", [2, 4])
def test_close_fingerprints_meet(threshold):
    rng = np.random.default_rng(threshold)
    x = rng.integers(-(2**63), 2**63 - 1, 400)
    y = x.view(np.uint64).copy()
    for k in range(len(y)):
        for b in rng.choice(64, threshold, replace=False).tolist():
            y[k] ^= np.uint64(1) << np.uint64(b)
    y = y.view(np.int64)
    beyond = 2 * threshold // 3
    anchors = simhash.Anchors(3 + beyond)
    met = np.zeros(len(x), bool)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        row, group, home = simhash.spread(anchors, x, i, j, beyond)
        at_home = dict(zip(row[home].tolist(), group[home].tolist(), strict=True))
        assert len(at_home) == len(x) == home.sum()
        row, group, _ = simhash.spread(anchors, y, i, j, beyond)
        assert len(set(zip(row.tolist(), group.tolist(), strict=True))) == len(row)
        met[[r for r, g in zip(row.tolist(), group.tolist(), strict=True) if at_home[r] == g]] = True
    assert met.all()


def test_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(-(2**63), 2**63 - 1, 300)
    fps = set(base.tolist())
    for x in base[:100]:
        for k in (1, 3, 4, 5):
            y = int(x) % 2**64
            for b in rng.choice(64, k, replace=False).tolist():
                y ^= 1 << b
            fps.add(y - 2**64 if y >= 2**63 else y)
    fps = {k: x for k, x in enumerate(sorted(fps))}
    distinct = spark.createDataFrame([(x,) for x in fps.values()], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.anchor_links(distinct)).collect()}
    want = slow_components({k: x % 2**64 for k, x in fps.items()})
    groups = lambda of: {frozenset(k for k in fps if of(k) == c) for c in {of(k) for k in fps}}
    assert groups(lambda k: got.get(fps[k], fps[k])) == groups(lambda k: want[k])


def test_query_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, component_id string").repartition(5)
    want = slow_components({i: slow_fingerprint(t) for i, t in rows})
    got = simhash.query(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{slow_fingerprint(t):016x}", want[i]) for i, t in rows}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_whole_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    want = slow_components(rows)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.query(docs).collect()}
    assert got == {i: (rows[i], want[i]) for i in rows}


@pytest.mark.parametrize("rows", [[], [(1, "a b c d e")] * 3, [(None, "a"), (2, "a")]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.query(docs).collect()
    assert len(got) == len(rows)
    if rows:
        assert {r.component_id for r in got} == {min(i for i, _ in rows if i is not None)}
        assert simhash.keep_first(docs).count() == 1


def test_chain_of_links(spark):
    """A long path: each node links to the next only."""
    links = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    got = simhash.components(links).collect()
    assert len(got) == 201 and {r.root for r in got} == {0}


def test_crowded_group_is_a_forest():
    fps = np.array(sorted({b1 | b2 for b1 in (1 << k for k in range(40)) for b2 in (1 << k for k in range(40))}), np.int64)
    a, b = simhash.forest(fps, np.ones(len(fps), bool), 4)
    assert len(a) == len(fps) - 1 and len(set(b.tolist())) == 1


def test_rows_with_null_and_repeated_ids_stay(spark):
    """Five distinct texts, two of null id and two of one id, are five rows; rows that are equal throughout are one."""
    rows = [(None, "p q r s t u", 1), (None, "k l m n o p", 2), (7, "aa bb cc dd ee", 3), (7, "ff gg hh ii jj", 4), (8, "vv ww xx yy zz", 5)]
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string, fp int")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
