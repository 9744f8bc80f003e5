"""SimHash near-duplicate detection by anchor-point covering.

A fingerprint has 64 bits. They are cut into three blocks of 21, 21 and 22 bits; of two fingerprints that differ in at most
`threshold` bits, two blocks differ in at most 2 * threshold // 3 bits together. The anchors of a block are the 4096 words of the
binary Golay code of length 23 (its covering radius is 3, so every block value has exactly one *home* anchor within 3
bits); the anchors of a fingerprint are pairs of these, for each pair of blocks. A fingerprint is replicated to every pair whose distances
beyond 3 add up to 2 * threshold // 3 at most: some 183 rows for 4 bits. If x and y link, then for some pair of blocks y
stands at x's home anchors. In a group only home members are compared with all members, on all 64 bits. So no link is lost, and none is
reported that isn't one. There are 3 * 2^24 groups, so that they stay small with very many distinct fingerprints.

A group never emits pairs: each hands on a spanning forest of its own links, at most one row a member. The forests are
joined by connected components over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialise
from tickloom.operators.graph import components

#: Fixed values of the binary Golay code: its length, and its generator polynomial
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY_BITS, GOLAY_POLYNOMIAL, GOLAY_RADIUS = 23, 0b110001110101, 3
#: Lowest bit and width of each block of a fingerprint.
BLOCKS = ((0, 21), (21, 21), (42, 22))
SHINGLE, SEED = 4, 42
#: Distances that a task holds at once.
CELLS = 1 << 22

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = np.arange(8, dtype=np.intp) * 256


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle of the whole text, in order, repeats included.

    A-Z are lower-cased, words are runs without blanks, shingles are space-joined. Fewer words than a shingle make one
    shingle; null, empty and blank texts have none.
    """
    parts = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII blanks only
    if not parts:
        return np.zeros(0, ">i8")
    digest = xxhash.xxh64_digest
    joined = b" ".join(parts)
    if len(parts) <= shingle:
        return np.frombuffer(digest(joined, SEED), ">i8")
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(length + 1) - 1
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip((end - length)[: 1 - shingle].tolist(), end[shingle - 1 :].tolist(), strict=True)]), ">i8")


def fingerprint(rows: np.ndarray) -> int:
    """The 64-bit SimHash of hashes, as a signed number; 0 of none."""
    octets = rows.view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts > len(octets)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row (doc_id, fp long) per row of docs; other columns are left out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(hashes(x.as_py(), shingle)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(scan, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, fp long")


def _syndromes() -> np.ndarray:
    """Of each byte at each of the three byte places of a 23-bit word; syndromes add up by exclusive or."""
    out = np.zeros((3, 256), np.int64)
    for place in range(3):
        for byte in range(256):
            rest = byte << 8 * place
            for bit in range(23, GOLAY_BITS - 13, -1):
                if rest >> bit & 1:
                    rest ^= GOLAY_POLYNOMIAL << (bit - 11)
            out[place, byte] = rest
    return out


class Anchors:
    """For a block value: the anchors within `radius` bits."""

    def __init__(self, radius: int) -> None:
        self.table = _syndromes()
        errors = [0]
        for _ in range(radius):
            errors = sorted({e | 1 << b for e in errors for b in range(GOLAY_BITS)} | set(errors))
        error = np.array(errors, np.int64)
        order = np.argsort(self.syndrome(error), kind="stable")
        self.error = error[order]
        self.beyond = np.maximum(np.bitwise_count(self.error).astype(np.int64) - GOLAY_RADIUS, 0)
        self.count = np.bincount(self.syndrome(self.error), minlength=2048)
        self.first = np.cumsum(self.count) - self.count

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.table[0][x & 255] ^ self.table[1][x >> 8 & 255] ^ self.table[2][x >> 16]

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row number, anchor and how far beyond the covering radius it is (0: the home anchor)."""
        s = self.syndrome(x)
        n = self.count[s]
        row = np.repeat(np.arange(len(x)), n)
        which = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[s], n)
        return row, x[row] ^ self.error[which], self.beyond[which]


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each of 0..n-1 reaches over the links a[i]-b[i]."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (deeper := label[label])).any():
            label = deeper


def forest(fps: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a group as (fingerprint, smallest in its part of the group), without those that are alone."""
    heads = np.flatnonzero(home)
    if len(fps) < 2 or not len(heads):
        return fps[:0], fps[:0]
    bits = fps.view(np.uint64)
    label = np.arange(len(fps))
    step = max(1, CELLS // len(fps))
    for at in range(0, len(heads), step):
        some = heads[at : at + step]
        i, j = np.nonzero(np.bitwise_count(bits[some][:, None] ^ bits[None, :]) <= threshold)
        i = some[i]
        other = i != j
        if other.any():
            linked = np.flatnonzero(label != np.arange(len(fps)))
            label = local_components(len(fps), np.concatenate([i[other], linked]), np.concatenate([j[other], label[linked]]))
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def block_values(fp: np.ndarray, block: int) -> np.ndarray:
    low, width = BLOCKS[block]
    return (fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)


def spread(anchors: Anchors, fp: np.ndarray, left: int, right: int, beyond: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, group and whether it is at home there, for the pairs of anchors of two blocks that are at most `beyond` beyond the covering radius together."""
    r1, a1, b1 = anchors.near(block_values(fp, left))
    r2, a2, b2 = anchors.near(block_values(fp, right))
    n2 = np.bincount(r2, minlength=len(fp))
    first = np.cumsum(n2) - n2
    one = np.repeat(np.arange(len(r1)), n2[r1])
    two = np.arange(len(one)) - np.repeat(np.cumsum(n2[r1]) - n2[r1], n2[r1]) + np.repeat(first[r1], n2[r1])
    kept = b1[one] + b2[two] <= beyond
    one, two = one[kept], two[kept]
    return r1[one], a1[one] | a2[two] << GOLAY_BITS | (left + right) << 2 * GOLAY_BITS, b1[one] + b2[two] == 0


def anchor_links(distinct: DataFrame, threshold: int = 4) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within `threshold` bits, as forests of the groups."""
    beyond = 2 * threshold // len(BLOCKS)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(GOLAY_RADIUS + beyond)
        for batch in batches:
            whole = batch.column(0).to_numpy()
            for at in range(0, len(whole), 500):
                fp = whole[at : at + 500]
                for i, j in ((0, 1), (0, 2), (1, 2)):
                    row, group, home = spread(anchors, fp, i, j, beyond)
                    yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(fp[row]), pa.array(home)], ["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            size = np.diff(np.append(start, len(anchor)))
            met = np.repeat((size > 1) & np.logical_or.reduceat(home, start), size)  # most groups have one member, or none at home
            anchor, fp, home = anchor[met], fp[met], home[met]
            cut = np.flatnonzero(np.diff(anchor)) + 1
            found = [forest(f, h, threshold) for f, h in zip(np.split(fp, cut), np.split(home, cut), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found]), pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:  # sorted by anchor: all but the last group of a batch are whole
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            if held[0][0][0] == held[-1][0][-1]:
                continue
            anchor, fp, home = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(anchor, anchor[-1]))
            yield links(anchor[:last], fp[:last], home[:last])
            held = [(anchor[last:], fp[last:], home[last:])]
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = distinct.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean")
    return dealt.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")


def row_key(docs: DataFrame, id_col: str) -> Column:
    """A total order of rows that differ: null ids last, then by id, then by two hashes of the whole row (maps left out)."""
    own = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return F.struct(F.col(f"`{id_col}`").isNull().alias("nameless"), F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(*own).alias("h"), F.xxhash64(F.lit(1), *own).alias("g"))


def one_of_each(docs: DataFrame, keys: DataFrame, id_col: str) -> DataFrame:
    """For each key (column key, none twice) the row of docs that has it, or one of the rows if several are equal throughout. All
    columns as they were. Key and row meet by id and hashes, which the rows are dealt by once for both."""
    key = row_key(docs, id_col)
    mine = docs.withColumns({"__tl_i": key["doc_id"], "__tl_h": key["h"], "__tl_g": key["g"]})
    theirs = keys.select(F.col("key.doc_id").alias("__tl_i2"), F.col("key.h").alias("__tl_h2"), F.col("key.g").alias("__tl_g2"))
    same = (F.col("__tl_h") == F.col("__tl_h2")) & (F.col("__tl_g") == F.col("__tl_g2")) & F.col("__tl_i").eqNullSafe(F.col("__tl_i2"))
    return mine.join(theirs, same, "left_semi").dropDuplicates(["__tl_h", "__tl_g", "__tl_i"]).drop("__tl_i", "__tl_h", "__tl_g")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed), component_id: the smallest doc_id that is reachable over links of
    `threshold` or fewer differing bits, itself included.

    Null, empty and blank texts share fingerprint 0 and link like any other. Repeated rows come out as often as they go
    in; a null doc_id counts as larger than any other and is a component's id only where it has no other. An empty table gives an
    empty result. Extra columns are left out, whatever their names.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    first = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    member = components(anchor_links(first, threshold))
    rooted = first.join(member, first.fp == member.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(rooted.select("fp", "root").join(smallest, "root").drop("root"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = 4) -> DataFrame:
    """The rows of docs of which one stays for each group of near duplicates: the one with the smallest id, null ids last, and of
    rows that share it the one with the smallest hash. Ids may be null or repeated: rows are told apart by all their columns. All
    columns come back as they were."""
    kept = docs.select(row_key(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = near_duplicates(kept, threshold=threshold, shingle=shingle)
    return one_of_each(docs, found.select(F.col("component_id").alias("key")).distinct(), id_col)


def query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
