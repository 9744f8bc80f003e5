import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import sharding


def check(rows, got, shards):
    text = dict(rows)
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    size, slots = defaultdict(int), defaultdict(list)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(size) <= set(range(shards))
    return size


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_near_equal(spark, shards):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sharding.shard(docs, shards=shards).collect()
    size = check(rows, got, shards)
    assert len(size) == shards
    largest = max(len((t or "").encode()) for _, t in rows)
    assert max(size.values()) - min(size.values()) <= 2 * largest


def test_target_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sharding.shard(docs, target_bytes=20_000).collect()
    total = sum(r["size"] for r in got)
    assert len({r.shard for r in got}) == -(-total // 20_000)


def test_one_hot_value(spark):
    rows = [(k, f"text {k % 7}") for k in range(2000)]
    docs = spark.createDataFrame([(i, t, "en", None, "s") for i, t in rows], "doc_id long, text string, lang string, source string, shard string")
    size = check(rows, sharding.shard(docs, shards=8).collect(), 8)
    assert max(size.values()) - min(size.values()) <= 16


def test_planes_separate_metadata(spark):
    """With two languages of equal bytes, the first cut is between them."""
    docs = spark.createDataFrame([(k, "same", "de" if k % 2 else "fr", "s") for k in range(400)], "doc_id long, text string, lang string, source string")
    got = sharding.shard(docs, shards=2).collect()
    assert {(r.doc_id % 2, r.shard) for r in got} == {(1, 0), (0, 1)}


def slow_tree(rows, shards):
    """Leaf of each row (coordinates, hash, id, size) by plain recursion."""
    extent = [max(r[0][d] for r in rows) - min(r[0][d] for r in rows) for d in range(len(rows[0][0]))]
    out = {}

    def go(part, base, k):
        if k == 1 or not part:
            out.update({r[2]: base for r in part})
            return
        width = [(max(r[0][d] for r in part) - min(r[0][d] for r in part)) / extent[d] if extent[d] else 0 for d in range(len(extent))]
        d = width.index(max(width))
        part = sorted(part, key=lambda r: (r[0][d], r[1], r[2], r[3]))
        goal, upto, best = sum(r[3] for r in part) * (k // 2) / k, 0, []
        for n, r in enumerate(part):
            upto += r[3]
            best.append((abs(upto - goal), n))
        n = min(best)[1] + 1
        go(part[:n], base, k // 2)
        go(part[n:], base + k // 2, k - k // 2)

    go(rows, 0, shards)
    return out


@pytest.mark.parametrize("shards", [2, 5, 8, 40])
def test_equals_plain_recursion(spark, shards):
    """The whole tree, with sources whose first bytes are equal."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("source", F.concat(F.lit("https://host.example/"), F.col("source")))
    meta = sharding.metadata(docs).collect()
    assert len({r.d2 for r in meta}) == docs.select("source").distinct().count()
    want = slow_tree([((r.d0, r.d1, r.d2), r.h, r.doc_id, r["size"]) for r in meta], shards)
    assert {r.doc_id: r.shard for r in sharding.shard(docs, shards=shards).collect()} == want


def test_groups_of_equal_texts(spark):
    """Of one language and source: a cut falls into at most as many groups as there are cuts."""
    rows = [(k, f"text number {k % 25} " * (k % 25 + 1), "en", "s") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    where = defaultdict(set)
    for r in sharding.shard(docs, shards=8).collect():
        where[rows[r.doc_id][1]].add(r.shard)
    assert sum(len(x) - 1 for x in where.values()) <= 7


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert sharding.query(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, None, None, None), (1, "x", "en", "s"), (1, "x", "en", "s"), (2, "", None, "s")]
    docs = spark.createDataFrame(rows, schema)
    got = sharding.query(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == [(False, 1, 2), (False, 1, 2), (False, 2, 1), (True, 0, 1)]
    out = sharding.with_shards(docs, shards=2)
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count() == 4
