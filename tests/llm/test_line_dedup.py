import random

import pytest
from pyspark.sql import functions as F

from tickloom.llm import line_dedup

SCHEMA = "doc_id long, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def slow(rows):
    """Kept line numbers by document."""
    lines = sorted((i, k, tuple(line.split())) for i, t in rows if t is not None for k, line in enumerate(t.split("\n")) if line.split())
    first = {}
    for i, k, w in lines:
        first.setdefault(w, (i, k))
    order = sorted((p, w) for w, p in first.items())
    kept = {i: [] for i, _ in rows}
    for n, ((i, k), w) in enumerate(order):
        if not any(len(v) >= 5 and len(w) >= 5 and distance(v, w) <= 1 for _, v in order[:n]):
            kept[i].append(k)
    return {i: sorted(v) for i, v in kept.items()}


def corpus(seed=1):
    rnd = random.Random(seed)
    pool = [[rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))] for _ in range(25)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rnd.randint(0, 6)):
            line = list(rnd.choice(pool))
            at = rnd.randrange(len(line))
            what = rnd.random()
            if what < 0.2:
                line[at] = rnd.choice("abcdefghij")
            elif what < 0.35:
                line.insert(at, rnd.choice("abcij"))
            elif what < 0.5:
                del line[at]
            text.append(rnd.choice([" ", "  ", "\t"]).join(line))
            if rnd.random() < 0.2:
                text.append(rnd.choice(["", "  "]))
        rows.append((i, "\n".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = line_dedup.query(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r.doc_id: [int(x) for x in r.kept_lines.split(",") if x] for r in got} == slow(rows)
    assert all(r.n_kept == len([x for x in r.kept_lines.split(",") if x]) for r in got)


def test_texts(spark):
    rows = [(1, "one two three four five\n\nkeep me"), (2, "one two three four six\nkeep me\nnew"), (3, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA + ", doc string")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "one two three four five\n\nkeep me", 2: "new", 3: None}


def test_a_common_template_needs_no_pairs(spark):
    """Thousands of lines equal but for one word: one stays, and no join makes more rows than variants."""
    rows = [(k, f"the access token is w{k} today") for k in range(3000)]
    got = line_dedup.query(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(r.doc_id for r in got if r.n_kept) == [0]


def test_edges(spark):
    assert line_dedup.query(spark.createDataFrame([], SCHEMA)).collect() == []
    long = " ".join(f"w{k}" for k in range(1500))
    rows = [(None, "a b c d e"), (1, ""), (2, None), (3, "a b c d e"), (4, long), (5, long + " more"), (6, "x\nx")]
    got = {r.doc_id: (r.n_lines, r.kept_lines) for r in line_dedup.query(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {None: (1, "0"), 1: (0, ""), 2: (0, ""), 3: (1, ""), 4: (1, "0"), 5: (1, ""), 6: (2, "0")}
    twice = spark.createDataFrame([(1, "a b"), (1, "a b")], SCHEMA)
    assert [r.kept_lines for r in line_dedup.query(twice).collect()] == ["0", "0"]


def test_within_one(spark):
    rnd = random.Random(4)
    pairs = []
    for _ in range(400):
        a = [rnd.choice("abc") for _ in range(rnd.randint(0, 6))]
        b = list(a)
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(b))
            b = rnd.choice([b[:at] + b[at + 1 :], b[:at] + ["x"] + b[at:], b[:at] + ["y"] + b[at + 1 :]])
        pairs.append((a, b, distance(a, b) <= 1))
    got = spark.createDataFrame(pairs, "a array<string>, b array<string>, want boolean").where(line_dedup.within_one(F.col("a"), F.col("b")) != F.col("want")).collect()
    assert got == []
