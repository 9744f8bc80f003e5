import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickloom.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"


def slow(text):
    text = text or ""
    w = [x for x in __import__("re").split("[ \t-\r]+", text) if x]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    many = Counter(windows)
    marked = {k + j for k, g in enumerate(windows) if many[g] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_features_equal_brute_force(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "x " * 3000, "w\x85x y\xa0z\x1cq"]
    texts += [rnd.choice([" ", "\n", "\v", " \t"]).join(rnd.choices(["a", "b", "c#", "d|", "é<"], k=rnd.randint(0, 60))) for _ in range(200)]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    got = quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in got:
        want = slow(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_held_out_labels(spark):
    """Nearly all good documents stay and nearly all bad ones go."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.quality(docs).join(labels, "doc_id").where("n_words >= 10").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] > 0.99 and kept[0] < 0.05


def test_sketches_merge_in_any_order(spark):
    rows = spark.range(5000).selectExpr("id % 7 AS g", "id * id % 9973 AS marks", "0L AS lines", "id % 3 AS repeats", "id AS length", "20L AS n_words", "0L AS n_repeat_words")
    whole = {tuple(r) for r in quality.sketch(rows, ["g"]).collect()}
    parts = quality.sketch(rows.where("length % 3 = 0"), ["g"]).union(quality.sketch(rows.where("length % 3 > 0"), ["g"]))
    assert {tuple(r) for r in quality.merge(parts, ["g"]).collect()} == whole
    assert not [x for x in whole if x[1] == "lines"] and not [x for x in whole if x[1] == "repeats" and x[2] == 0]


def test_bucket_keeps_seven_bits(spark):
    rows = spark.createDataFrame([(x,) for x in [0, 1, 127, 128, 129, 255, 256, 1000, 123456789]], "v long").select("v", quality.bucket(F.col("v")).alias("b")).collect()
    assert all(r.b <= r.v and r.v - r.b <= r.v / 64 for r in rows)


def test_thresholds_adapt(spark):
    """A source whose texts are tables keeps them; the same text in another source goes."""
    prose, tablerow = "word text more of this kind and some that differ by {}", "cell | cell {} | more | cells | here | and | there | too | ok"
    rows = [(k, tablerow.format(k), "en", "tables") for k in range(300)] + [(1000 + k, prose.format(k), "en", "prose") for k in range(300)] + [(5000, tablerow.format("x"), "en", "prose")]
    kept = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(v for k, v in kept.items() if k != 5000) and not kept[5000]


def test_every_bound_moves_between_sources_of_the_documents(spark):
    """All four measures have bounds of their own in the sources of the test table, and none lies at its slack."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = quality._measures(quality.materialise(quality.features(docs, "text", F.col("lang"), F.col("source")), "features"))
    bounds = quality.thresholds(quality.sketch(rows, ["lang", "source"]), ["lang", "source"], 10).where("lang = 'en'").collect()
    for name in [f"{m}_max" for m in quality.MEASURES] + ["length_min"]:
        values = {b[name] for b in bounds} - {None}
        assert len(values) > 3 and min(values) > 2 * quality.SLACK, (name, values)


def test_repeats_below_the_base_rule_go(spark):
    """A text with 19 percent of its words repeated goes where texts repeat less, and stays where all do."""
    words = lambda k, n: [f"w{k}x{j}" for j in range(n)]

    def text(k, n, again):
        w = words(k, n)
        return " ".join(w + w[:again])

    rows = [(k, text(k, 380, 5), "en", "plain") for k in range(300)] + [(1000 + k, text(1000 + k, 100, 8 + k % 4), "en", "loops") for k in range(300)]
    rows += [(5000, text(5000, 100, 10), "en", "plain"), (5001, text(5001, 100, 10), "en", "loops")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[5000].base_failed and not got[5000].kept and got[5001].kept
    assert all(r.kept for k, r in got.items() if k < 5000)


def test_repeated_rows_and_columns(spark):
    """Null ids, one id with two texts and repeated rows: every row that the rules keep stays, as often as it stands there."""
    good = "word text more of this kind and some that differ by number {}"
    rows = [(None, good.format(1), "en", "s"), (None, good.format(1), "en", "s"), (7, good.format(2), "en", "s"), (7, "x", "en", "s"), (8, good.format(3), None, None)]
    docs = spark.createDataFrame([(*r, 1, "f") for r in rows], SCHEMA + ", n_marks int, marks string")
    got = quality.keep_good(docs)
    assert got.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted((r[0] or 0, r[1]) for r in rows if r[1] != "x")


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(1, "a " * 30, None, "s")] * 3])
def test_edges(spark, rows):
    docs = spark.createDataFrame([(*r, 5, True) for r in rows], SCHEMA + ", n_words int, kept boolean")
    assert quality.quality(docs).count() == len(rows)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and good.count() <= len(rows)


def test_keep_good_keeps_what_quality_keeps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == want
