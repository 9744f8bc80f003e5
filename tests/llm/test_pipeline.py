import __spark_entry__ as entry
import corpus_pipeline as pipeline

from tickloom.llm import simhash

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    """Each stage against a plain account of what it should do."""
    from tests.llm.test_decontam import slow as slow_hits
    from tests.llm.test_near import slow as slow_near

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stage = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontaminate", "mix_sources", "shard"]

    good = stage["quality_rules"](spark, docs, SF).persist()
    from tickloom.llm import quality

    assert good.columns == columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.quality(docs).where("kept").collect()}

    single = stage["near_duplicates"](spark, good, SF).persist()
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(slow_near([(r.doc_id, r.text) for r in good.collect()]).values()))

    clean = stage["decontaminate"](spark, single, SF).persist()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text) for r in single.collect()]
    want = {r[0] for r in slow_hits(rows, items) if not r[5]}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == want

    mixed = stage["mix_sources"](spark, clean, SF).persist()
    from tickloom.llm import mixing

    times = {r.doc_id: int(r.taken / max(1, r["size"]) + 0.5) if r["size"] else 1 for r in mixing.mix(clean).collect()}
    count = {}
    for r in mixed.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert mixed.columns == columns and count == {k: v for k, v in times.items() if v}

    sharded = stage["shard"](spark, mixed, SF).collect()
    assert sorted(r.doc_id for r in sharded) == sorted(r.doc_id for r in mixed.collect())
    slots = {}
    for r in sharded:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(8))
    for df in (good, single, clean, mixed):
        df.unpersist()


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 0


def test_registered():
    assert {"pipeline"} | {n for n in entry.queries() if n.startswith("op")} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")) == list(range(1, 11))
    assert simhash.SEED == 42


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, slot int"


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_over_odd_rows(spark, tmp_path):
    """Null ids, texts, languages and sources, repeated rows, one id with two texts and columns named like the operators' own: every distinct good text
    comes out once or as often as the mix takes it, with its own columns."""
    good = [" ".join(f"word{k}x{j}" for j in range(30)) + "." for k in range(12)]
    rows = [(k, t, "en", "s", len(t), f"r{k}", 5) for k, t in enumerate(good[:6])] * 2
    rows += [(None, good[6], "en", "s", 1, None, None), (None, good[7], None, None, 2, "a", 1), (7, good[8], "en", "t", 3, "b", 2), (7, good[9], "en", "t", 4, "c", 3)]
    rows += [(20, None, "en", "s", 0, None, None), (21, "", "en", "s", 0, None, None), (22, "short text", "en", "s", 9, None, None)]
    rows += [(23, good[10] + " the quick brown fox jumps over the lazy dog again and again", "en", "s", 0, None, None)]
    out = pipeline.run(spark, write(spark, tmp_path, rows)).collect()
    assert {r.text for r in out} <= set(good[:10]) and len({r.text for r in out}) >= 7
    assert {(r.doc_id, r.text, r.lang, r.source, r.n_chars, r.root) for r in out} <= {r[:6] for r in rows}
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_run_over_an_empty_table(spark, tmp_path):
    assert pipeline.run(spark, write(spark, tmp_path, [])).collect() == []
