"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. A test item's windows are
its runs of `n` consecutive words; an item of fewer words (not none) is one window. The same hash is rolled over the words of each training
text and of the benchmark, and looked up in a table of bits sized by the number of windows.

A benchmark whose texts take up at most `block_bytes` is broadcast: each worker keeps its window hashes in one sorted array beside its normalised words
(some four times the texts, whatever the number of windows) and verifies each hit word by word. A larger one stays a table: its
windows are hashed in Spark, only the bits go to the driver and to the tasks (32 MB a size of window at most), and only the text windows that the bits let pass are joined
with it, by two hashes of 64 bits each. Nothing is sampled or cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import bit_table, in_table, materialise, table_bits

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(x): ord(x) + 32 for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
WINDOW = 10
BLOCK_BYTES = 8 << 20


def lower_ascii(text: str) -> str:
    """A-Z to a-z; other letters stay, whatever their case."""
    return text.lower() if text.isascii() else text.translate(LOWER)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lower_ascii(text)) if text else []


def word_hashes(found: list[str], seed: int = 0) -> np.ndarray:
    """The same in every process."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in found), np.uint64, len(found))


def own_hashes(found: list[str]) -> np.ndarray:
    """Python's own, several times as fast: they hold within a process only."""
    return np.fromiter(map(hash, found), np.int64, len(found)).view(np.uint64)


def roll(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of `size` words."""
    out = hashes[: len(hashes) - size + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, size):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out += hashes[k : len(hashes) - size + 1 + k]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


class Windows:
    """The windows of (item_id, text) rows: per size the sorted hashes, and for each the item and where its words begin."""

    def __init__(self, items: list[tuple], n: int) -> None:
        self.names = sorted({"" if i is None else str(i) for i, _ in items})
        at = {name: k for k, name in enumerate(self.names)}
        parts, length, starts = [], 0, []
        sizes: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        for item, text in items:
            found = words_of(text)
            if found:
                size = min(n, len(found))
                place = len(starts) + np.arange(len(found) - size + 1)
                sizes.setdefault(size, []).append((roll(own_hashes(found), size), place, at["" if item is None else str(item)]))
                for w in found:
                    starts.append(length)
                    parts.append(w)
                    length += len(w) + 1
        self.words, self.starts = " ".join(parts), np.array([*starts, length], np.int64)
        self.by_size = {}
        for size, rows in sorted(sizes.items()):
            hashes = np.concatenate([h for h, _, _ in rows])
            order = np.argsort(hashes, kind="stable")
            item = np.concatenate([np.full(len(p), i, np.int32) for _, p, i in rows])[order]
            bits = table_bits(len(hashes))
            table = np.zeros(1 << bits, bool)
            table[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
            table = np.packbits(table, bitorder="little")
            self.by_size[size] = (hashes[order], np.concatenate([p for _, p, _ in rows])[order], item, bits, table)

    def scan(self, found: list[str]) -> list[tuple[int, int, set[str]]]:
        """(first word, number of words, items) of each occurrence of a window."""
        out = []
        if found and self.by_size:
            own = own_hashes(found)
            for size, (hashes, place, item, bits, table) in self.by_size.items():
                if len(found) < size:
                    continue
                rolled = roll(own, size)
                for at in np.flatnonzero(in_table(rolled, bits, table)).tolist():
                    low, high = np.searchsorted(hashes, rolled[at], "left"), np.searchsorted(hashes, rolled[at], "right")
                    if low == high:
                        continue
                    text = " ".join(found[at : at + size])
                    same = {self.names[item[k]] for k in range(low, high) if self.words[self.starts[place[k]] : self.starts[place[k] + size] - 1] == text}
                    if same:
                        out.append((at, size, same))
        return out


def _small(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> dict | None:
    """The benchmark's distinct rows (items), if their texts take up at most block_bytes."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    return {"items": [tuple(x) for x in rows.collect()]} if total <= block_bytes else None


def windows_of(small: dict, n: int) -> Windows:
    """The windows of a broadcast benchmark; each worker builds them once, for itself, and keeps them beside the rows."""
    if "built" not in small:
        small["built"] = Windows(small["items"], n)
    return small["built"]


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """(size, h, g, item) of the windows of all items: two hashes of their words."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = words_of(text)
                if found:
                    size = min(n, len(found))
                    h, g = (roll(word_hashes(found, seed), size).view(np.int64) for seed in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), size, np.int32)), pa.array(h), pa.array(g), pa.array([item] * len(h), pa.string())], ["size", "h", "g", "item"])

    return rows.mapInArrow(scan, "size int, h long, g long, item string").distinct()


def _large_hits(docs: DataFrame, benchmark: DataFrame, n: int, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_words) of docs (doc_id, text), and (row, at, n, item) of their hits, for a benchmark of any size."""
    windows = materialise(benchmark_windows(benchmark, item_col, item_text_col, n), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # up to n of them
    shared = docs.sparkSession.sparkContext.broadcast({size: bit_table(windows.where(F.col("size") == size), "h") for size in sizes})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {size: (bits, np.frombuffer(raw, np.uint8)) for size, (bits, raw) in shared.value.items()}
        cell = pa.struct([("size", pa.int32()), ("at", pa.int32()), ("h", pa.int64()), ("g", pa.int64())])
        for batch in batches:
            total, passed = [], []
            for text in batch.column(1):
                found, rows = words_of(text.as_py()), []
                own = word_hashes(found) if found else None
                for size, (bits, table) in tables.items():
                    if len(found) >= size:
                        h = roll(own, size)
                        at = np.flatnonzero(in_table(h, bits, table))
                        if len(at):
                            g = roll(word_hashes(found, 1), size)
                            rows += [{"size": size, "at": k, "h": x, "g": y} for k, x, y in zip(at.tolist(), h[at].view(np.int64).tolist(), g[at].view(np.int64).tolist(), strict=True)]
                total.append(len(found))
                passed.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(passed, pa.list_(cell))], ["doc_id", "n_words", "passed"])

    scanned = docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, passed array<struct<size: int, at: int, h: bigint, g: bigint>>")
    rows = materialise(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    spread = rows.select("row", F.explode("passed").alias("p")).select("row", "p.*")
    return rows.drop("passed"), spread.join(windows, ["size", "h", "g"]).select("row", "at", F.col("size").alias("n"), "item")


def scan_windows(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, hits (array of first word, number of words), items (sorted, as strings).

    Null, empty and wordless texts have no words and no hits; null and wordless items have no windows; a null item_id
    counts as the empty string. Repeated items are one. An empty benchmark hits nothing; extra columns are left out.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    small = _small(benchmark, item_col, item_text_col, block_bytes)
    if small is None:
        rows, hits = _large_hits(kept, benchmark, n, item_col, item_text_col)
        found = hits.groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("hits"), F.sort_array(F.collect_set("item")).alias("items"))
        none = {"hits": "array<struct<at: int, n: int>>", "items": "array<string>"}
        return rows.join(found, "row", "left").select("doc_id", "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()])
    shared = docs.sparkSession.sparkContext.broadcast(small)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = windows_of(shared.value, n)
        hit = pa.struct([("at", pa.int32()), ("n", pa.int32())])
        for batch in batches:
            total, hits, named = [], [], []
            for text in batch.column(1):
                found = words_of(text.as_py())
                met = windows.scan(found)
                total.append(len(found))
                hits.append([{"at": at, "n": size} for at, size, _ in met])
                named.append(sorted(set().union(*(x for _, _, x in met))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(hits, pa.list_(hit)), pa.array(named, pa.list_(pa.string()))], ["doc_id", "n_words", "hits", "items"])

    return kept.mapInArrow(scan, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_words long, hits array<struct<at: int, n: int>>, items array<string>")


def covered(hits: list, total: int) -> int:
    """Words that the hits cover."""
    end, out = 0, 0
    for at, n in sorted(hits):
        out += max(0, min(total, at + n) - max(end, at))
        end = max(end, at + n)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, **names) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256
    (of the sorted, comma-joined item ids) and contaminated."""
    found = scan_windows(docs, benchmark, n, **names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(1).to_pylist()
            hit = [covered([(h["at"], h["n"]) for h in hits], w) for hits, w in zip(batch.column(2).to_pylist(), total, strict=True)]
            items = batch.column(3).to_pylist()
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in hit], pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.mapInArrow(digest, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, spans_only: bool = False) -> DataFrame:
    """docs without the rows in which a window occurs, or, with spans_only, with every word that a window covers (and
    what stands between two such words) cut out of the text. Rows and columns otherwise come back as they were, also if
    columns are named like this operator's own. With a benchmark beyond block_bytes the texts in question are found by hash and joined back."""
    at = docs.columns.index(text_col)
    small = _small(benchmark, item_col, item_text_col, block_bytes)
    if small is None:
        keyed = docs.select(F.struct(F.xxhash64(F.col(text_col)).alias("h"), F.xxhash64(F.lit(1), F.col(text_col)).alias("g")).alias("doc_id"), F.col(text_col).alias("text"))
        rows, hits = _large_hits(keyed, benchmark, n, item_col, item_text_col)
        met = hits.groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("met"))
        bad = materialise(rows.join(met, "row").groupBy("doc_id").agg(F.first("met").alias("__tl_met")), "contaminated")
        bad = bad.select(F.col("doc_id.h").alias("__tl_h"), F.col("doc_id.g").alias("__tl_g"), "__tl_met")
        same = (F.xxhash64(F.col(text_col)) == F.col("__tl_h")) & (F.xxhash64(F.lit(1), F.col(text_col)) == F.col("__tl_g"))
        if not spans_only:
            return docs.join(bad, same, "left_anti")
        cut = F.pandas_udf(lambda texts, met: pd.Series([t if m is None else cut_spans(t, [(x["at"], x["n"], set()) for x in m]) for t, m in zip(texts, met, strict=True)]), "string")
        return docs.join(bad, same, "left").withColumn(text_col, cut(F.col(text_col), F.col("__tl_met"))).drop("__tl_h", "__tl_g", "__tl_met")
    shared = docs.sparkSession.sparkContext.broadcast(small)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = windows_of(shared.value, n)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            met = [windows.scan(words_of(x)) for x in texts]
            if spans_only:
                cut = pa.array([cut_spans(x, m) if m else x for x, m in zip(texts, met, strict=True)], batch.column(at).type)
                yield batch.set_column(at, batch.schema.field(at), cut)
            else:
                yield batch.filter(pa.array([not m for m in met], pa.bool_()))

    return docs.mapInArrow(sift, docs.schema)


def cut_spans(text: str, met: list[tuple[int, int, set[str]]]) -> str:
    places = [m.span() for m in WORD.finditer(lower_ascii(text))]
    out, end = [], 0
    for at, n, _ in sorted(met, key=lambda x: x[:2]):
        start, stop = places[at][0], places[at + n - 1][1]
        if start > end:
            out.append(text[end:start])
        end = max(end, stop)
    return "".join([*out, text[end:]])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(w, p, p + 9) g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) n FROM iw),
dw AS (SELECT r, p, n, list_slice(w, p, p + n - 1) g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) p FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT r, p, n, item_id FROM dw JOIN iw USING (g)),
hit AS (SELECT r, count(DISTINCT q) n_hit FROM (SELECT r, unnest(range(p, p + n)) q FROM h) GROUP BY r),
it AS (SELECT r, count(*) n_items, string_agg(x, ',' ORDER BY x) xs FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') x FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(xs, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
