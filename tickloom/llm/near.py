"""Near duplicates by similarity of word shingles: SimHash anchors, confirmed exactly, and an exact join for what SimHash can't see.

Two texts are near duplicates if their sets of shingles have a Jaccard similarity of at least 4/5. Their SimHash fingerprints then differ in some
ten bits on average, beyond what an anchor covering can reach, so links are found in three rounds, each confirmed on the whole sets:

1. Anchors: fingerprints within 4 bits, by simhash.anchor_links. This joins exact and nearly exact copies, however many there are.
2. Stars: texts of different components that share a rare shingle are held against the smallest of those that share it.
3. Of the shingles that many sets share, the sets are compared where they meet, by sketches; each component hands on its closest pair, until no
   such pair is similar any more.
4. All pairs of different components that are left: by sketches where they share a shingle of many sets, by the number of rare shingles they share elsewhere.

Rounds 2 to 4 are a prefix-filtered set similarity join. All sets are ordered alike, rare shingles first. Two sets with a similarity of at
least 4/5 share at least ceil(4/5 n) of the n shingles of either, so they share one among the first n - ceil(4/5 n) + 1 of each: only these
prefixes are dealt, and no pair is lost. Shingles that a sample of the texts has often come last, by their count, so that wording that many
texts have hardly stands in prefixes; the order changes the work, never the result.

A shingle of few sets hands on each pair, and a pair is a candidate if it shares enough of its prefixes: behind the prefix that ends first at most
ceil(4/5 n) - 1 shingles are left, and 4/9 of both sizes together must be shared. A shingle of many sets would hand on the square of their number. There
each set brings a sketch: for each place of a hash table whether an odd number of its shingles fall there. Two sketches differ in no more
places than their sets in shingles, and two sets are similar if they differ in at most a ninth of both sizes together, so pairs whose sketches differ in more
aren't similar and none that is similar is left out. In round 3 a place hands on at most one pair a component. By round 4 what passes is
little: pairs that just miss the similarity. A shingle with very many sets is dealt as pairs of blocks, so no task holds more than two blocks of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import bit_table, discard, in_table, materialise
from tickloom.llm.simhash import SEED, anchor_links, fingerprint, hashes, one_of_each, row_key
from tickloom.operators.graph import components

#: Similarity as a fraction, so that all comparisons are of whole numbers.
NUM, DEN = 4, 5
#: One text in so many is looked at for frequent shingles; so often a shingle must occur there; so many are kept at most.
SAMPLE, OFTEN, FREQUENT = 16, 8, 1_000_000
#: Comparisons that a task holds at once, and sets of a shingle in a block (fewer, if they are long).
CELLS, BLOCK = 1 << 18, 1 << 13
#: A shingle with so many sets at most hands on all their pairs; so many words of 64 bits has a sketch at least; so often round 3 is repeated at most.
LIGHT, WORDS, ROUNDS = 64, 16, 6


def distinct(rows: np.ndarray) -> np.ndarray:
    """Hashes without repeats, in order, as signed numbers."""
    return np.unique(rows.astype(np.int64))


def digest(whole: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(whole.tobytes(), SEED), "big", signed=True)


def prefix_length(n: int) -> int:
    return n - (NUM * n + DEN - 1) // DEN + 1 if n else 0


def frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that the sampled texts (column text) have often, in order, and their places by rising count."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(distinct(hashes(text.as_py(), shingle)))], ["s"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    often = some.mapInArrow(scan, "s long").groupBy("s").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "s").limit(FREQUENT)
    names = np.array([r.s for r in often.collect()], np.int64)[::-1]
    order = np.argsort(names)
    return names[order], order


def sets(docs: DataFrame, shingle: int) -> DataFrame:
    """One row (doc_id, set_id, fp, n, prefix) per row of docs (doc_id, text): the hash of its set of shingles, its fingerprint, the set's size and prefix."""
    names, place = frequent(docs, shingle)
    shared = docs.sparkSession.sparkContext.broadcast((names, place))  # FREQUENT shingles at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, place = shared.value
        for batch in batches:
            ids, fps, sizes, prefixes = [], [], [], []
            for text in batch.column(1):
                found = hashes(text.as_py(), shingle)
                s = distinct(found)
                ids.append(digest(s))
                fps.append(fingerprint(found))
                sizes.append(len(s))
                if len(names) and len(s):
                    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                    s = s[np.argsort(np.where(names[at] == s, place[at], -1), kind="stable")]
                prefixes.append(s[: prefix_length(len(s))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "set_id", "fp", "n", "prefix"])

    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, set_id long, fp long, n int, prefix array<long>")


def needed(n1, n2, larger):
    """How many shingles the prefixes of sets of these sizes must share: of numbers, arrays or columns; larger: the larger size."""
    both, behind = NUM * (n1 + n2) + NUM + DEN - 1, NUM * larger + DEN - 1
    return (both - both % (NUM + DEN)) / (NUM + DEN) - (behind - behind % DEN) / DEN + 1


def sketch_words(n: int) -> int:
    """Words of 64 bits of the sketch of a set of n: 16 or more places for each shingle that similar sets may differ in. Similar sets have as many words, or one twice as many."""
    return max(WORDS, 1 << (n // 18).bit_length())


def sketch(whole: np.ndarray) -> bytes:
    """Bits that are set where an odd number of the hashes fall; the exclusive or of its halves is the sketch of half its length."""
    places = 64 * sketch_words(len(whole))
    odd = np.bincount((whole.view(np.uint64) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """The other columns of each group of rows with the same first column, by which the rows are sorted; some groups at a time."""
    held: list[tuple[np.ndarray, ...]] = []

    def split(s: np.ndarray, *columns: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        cut = np.flatnonzero(np.diff(s)) + 1
        return list(zip(*(np.split(c, cut) for c in columns), strict=True))

    for batch in batches:  # all but the last group of a batch are whole
        if not batch.num_rows:
            continue
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        if held[0][0][0] == held[-1][0][-1]:
            continue
        whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        last = int(np.searchsorted(whole[0], whole[0][-1]))
        yield split(*(c[:last] for c in whole))
        held = [tuple(c[last:] for c in whole)]
    if held:
        yield split(*(np.concatenate(x) for x in zip(*held, strict=True)))


def cross_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (s, set_id, n, root) that stand in different components and share enough of s to be similar. Each group of s hands on
    all its pairs of sizes that can be similar, so that s should have few sets."""

    def group(ids: np.ndarray, n: np.ndarray, root: np.ndarray) -> Iterator[np.ndarray]:
        if (root == root[0]).all():
            return
        order = np.argsort(n, kind="stable")
        ids, n, root = ids[order], n[order].astype(np.int64), root[order]
        upto = np.searchsorted(NUM * n, DEN * n, side="right")  # sizes up to n / similarity
        at = 0
        while at < len(ids) - 1:
            step = max(1, min(len(ids) - at, CELLS // max(1, int(upto[at]) - at)))
            end = int(upto[min(at + step, len(ids)) - 1])
            one, two = slice(at, at + step), slice(at, end)
            fits = (NUM * n[two][None, :] <= DEN * n[one][:, None]) & (root[one][:, None] != root[two][None, :])
            i, j = np.nonzero(np.triu(fits, 1))
            if len(i):
                yield np.stack([np.minimum(ids[one][i], ids[two][j]), np.maximum(ids[one][i], ids[two][j]), needed(n[one][i], n[two][j], n[two][j]).astype(np.int64)])
            at += step

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(parts: list[np.ndarray]) -> pa.RecordBatch:
            a, b, need = np.concatenate(parts, axis=1)
            order = np.lexsort((b, a))
            a, b, need = a[order], b[order], need[order]
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            count = np.diff(np.append(starts, len(a)))
            return pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(need[starts]), pa.array(count)], ["a", "b", "need", "n"])

        for parts in whole_groups(batches):
            ready, size = [], 0
            for part in parts:
                for pairs in group(*part):
                    ready.append(pairs)
                    size += pairs.shape[1]
                    if size >= 1 << 16:
                        yield batch_of(ready)
                        ready, size = [], 0
            if ready:
                yield batch_of(ready)

    dealt = rows.select("s", "set_id", "n", "root").repartition("s").sortWithinPartitions("s")
    found = dealt.mapInArrow(compare, "a long, b long, need long, n long").groupBy("a", "b", "need").agg(F.sum("n").alias("n"))
    return found.where("n >= need").select("a", "b")


def passing(ids: np.ndarray, n: np.ndarray, root: np.ndarray, side: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of a group's rows, by number, of different components and sides (2: of any) whose sketches differ in no more than similar sets may, and how much less."""
    order = np.argsort(n, kind="stable")
    n, root, side, sketches = n[order].astype(np.int64), root[order], side[order], sketches[order]
    upto = np.searchsorted(NUM * n, DEN * n, side="right")
    words = np.fromiter(map(len, sketches), np.int64, len(sketches)) // 8
    for w in np.unique(words).tolist():
        first, mid, last = (int(np.searchsorted(words, x, side=end)) for x, end in ((w, "left"), (w, "right"), (2 * w, "right")))
        longer = np.frombuffer(b"".join(sketches[mid:last]), np.uint64).reshape(-1, 2, w)
        bits = np.concatenate([np.frombuffer(b"".join(sketches[first:mid]), np.uint64).reshape(-1, w), longer[:, 0] ^ longer[:, 1]])
        at = first
        while at < mid:
            step = max(1, min(mid - at, CELLS // max(1, int(upto[at]) - at)))
            one, two = slice(at, at + step), slice(at, int(upto[at + step - 1]))
            fits = (NUM * n[two][None, :] <= DEN * n[one][:, None]) & (root[one][:, None] != root[two][None, :]) & ((side[one][:, None] != side[two][None, :]) | (side[one][:, None] == 2))
            i, j = np.nonzero(np.triu(fits, 1))
            few = max(1, CELLS // w)
            for k in range(0, len(i), few):
                x, y = i[k : k + few] + at, j[k : k + few] + at
                spare = (DEN - NUM) * (n[x] + n[y]) // (DEN + NUM) - np.bitwise_count(bits[x - first] ^ bits[y - first]).sum(1, np.int64)
                if (kept := spare >= 0).any():
                    yield order[x[kept]], order[y[kept]], spare[kept]
            at += step


def closest(root: np.ndarray, found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the pairs found of rows of these components, for each component the one with most to spare."""
    names, at = np.unique(root, return_inverse=True)
    best = np.full((3, len(names)), -1, np.int64)
    for i, j, spare in found:
        r, i, j, spare = np.concatenate([at[i], at[j]]), np.tile(i, 2), np.tile(j, 2), np.tile(spare, 2)
        order = np.lexsort((-spare, r))
        order = order[np.concatenate([[True], np.diff(r[order]) > 0])]
        order = order[spare[order] > best[2, r[order]]]
        best[:, r[order]] = i[order], j[order], spare[order]
    i, j, spare = np.unique(best[:, best[2] >= 0], axis=1)
    yield i, j, spare


def block_pairs(rows: DataFrame, sketches: DataFrame, every: bool) -> DataFrame:
    """Pairs (a, b) of rows (s, set_id, n, root, blocks) that share s, stand in different components and may be similar by their sketches (set_id,
    sketch): every such pair, or of each component the closest ones, one a place.

    The sets of a shingle fall into blocks by hash; a set goes to every pair of blocks with its own."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in whole_groups(batches):
            for part in parts:
                ids, _, root, *_ = part
                if (root == root[0]).all():
                    continue
                found = passing(*part)
                for i, j, _ in found if every else closest(root, found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], ["a", "b"])

    own = F.pmod(F.col("set_id"), F.col("blocks"))
    spread = rows.join(sketches, "set_id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    place = F.when(F.col("blocks") == 1, F.col("s")).otherwise(F.xxhash64("s", F.least("own", "other"), F.greatest("own", "other")))
    dealt = spread.select(place.alias("s"), "set_id", "n", "root", side.alias("side"), "sketch").repartition("s").sortWithinPartitions("s")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def ends(pairs: DataFrame) -> DataFrame:
    """The set ids (set_id) of pairs (a, b), none twice."""
    return pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()


def whole_sets(some: DataFrame, docs: DataFrame, first: DataFrame, shingle: int) -> DataFrame:
    """The whole sets (set_id, whole) of some ids (set_id, none twice), written. first: the key of a row for each set, docs: key (with a hash h) and text."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(first.join(some, "set_id", "left_semi").select("first_id.h"), "h"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, table = shared.value
        table = np.frombuffer(table, np.uint8)
        for batch in batches:
            for k in np.flatnonzero(in_table(batch.column(0).to_numpy(), bits, table)).tolist():  # a row at a time: sets may be long
                whole = distinct(hashes(batch.column(1)[k].as_py(), shingle))
                yield pa.RecordBatch.from_arrays([pa.array([digest(whole)], pa.int64()), pa.array([whole], pa.list_(pa.int64()))], ["set_id", "whole"])

    # texts stay where they are: only the sets of rows that the table lets pass are dealt
    return materialise(docs.select("doc_id.h", "text").mapInArrow(scan, "set_id long, whole array<long>").join(some, "set_id", "left_semi"), "shingles")


def sketched(whole: DataFrame) -> DataFrame:
    """The sketches (set_id, sketch) of whole sets, one a set, written."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(np.array(batch.column(1)[k].values, np.int64)) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["set_id", "sketch"])

    return materialise(whole.mapInArrow(scan, "set_id long, sketch binary").dropDuplicates(["set_id"]), "sketches")


def similar(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids that are similar enough by their whole sets, written."""
    left, right = (whole.dropDuplicates(["set_id"]).toDF(*names) for names in (("a", "one"), ("b", "two")))
    sides = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("one", "two")))
    return materialise(sides.where((NUM + DEN) * F.col("both") >= NUM * (F.size("one") + F.size("two"))).select("a", "b"), "similar")


def confirmed(pairs: DataFrame, docs: DataFrame, first: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of set ids whose whole sets are similar enough, written. first and docs as for whole_sets."""
    pairs = materialise(pairs, "candidates")
    whole = whole_sets(ends(pairs), docs, first, shingle)
    out = similar(pairs, whole)
    discard(pairs, whole)
    return out


def anchored(first: DataFrame) -> DataFrame:
    """Pairs (a, b) of set ids whose fingerprints are equal, or lie in one part of an anchor's group; written."""
    fps = materialise(first.groupBy("fp").agg(F.min("set_id").alias("rep")), "distinct-fingerprints")
    links = materialise(anchor_links(fps), "anchor-links")
    equal = first.join(fps, "fp").where("set_id > rep").select(F.col("rep").alias("a"), F.col("set_id").alias("b"))
    named = links.distinct().join(fps.toDF("a", "x"), "a").join(fps.toDF("b", "y"), "b")
    out = materialise(equal.union(named.select(F.least("x", "y"), F.greatest("x", "y")).distinct()), "anchored")
    discard(fps, links)
    return out


def roots(links: DataFrame) -> DataFrame:
    """(set_id, above) of the sets that have links: the smallest that each reaches."""
    return materialise(components(links), "members").toDF("set_id", "above")


def similar_links(first: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) of set ids that connect all sets with a similarity of at least 4/5, written. first: set_id, fp, n, prefix and first_id, one per set."""
    keys = first.select("set_id", "first_id")
    near = anchored(first)
    links = confirmed(near, docs, keys, shingle)
    member = roots(links)
    rooted = first.select("set_id", "n", "prefix").join(member, "set_id", "left").select("set_id", "n", F.coalesce("above", "set_id").alias("root"), "prefix")
    spread = rooted.select("set_id", "n", "root", F.explode("prefix").alias("s"))
    groups = spread.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high"))  # few bytes: every shingle of a prefix is dealt
    shared = materialise(spread.join(groups.where("low < high").select("s"), "s", "left_semi"), "shared-shingles")
    least = shared.groupBy("s").agg(F.count("*").alias("members"), F.min(F.struct("set_id", "n", "root")).alias("least"))
    sizes = F.col("n").cast("long"), F.col("least.n").cast("long")
    alike = NUM * F.greatest(*sizes) <= DEN * F.least(*sizes)
    stars = shared.join(least, "s").where((F.col("root") != F.col("least.root")) & alike).select(F.col("least.set_id").alias("a"), F.col("set_id").alias("b"), needed(*sizes, F.greatest(*sizes)).alias("need"))
    stars = stars.groupBy("a", "b", "need").count().where("count >= need").select("a", "b")  # all of a pair that share their least; the rest is left to the pairs below
    found = confirmed(stars, docs, keys, shingle)
    links = links.union(found)
    spent = [near, found, shared]

    def apart() -> DataFrame:
        """What the sets that stand in different components by now still share: s, set_id, n, root, members, blocks."""
        now = shared.drop("root").join(roots(links), "set_id", "left").withColumn("root", F.coalesce("above", "set_id")).drop("above")
        length = F.sum(F.greatest(F.lit(float(WORDS)), F.col("n") / 9))  # words of all sketches, and some more
        split = now.groupBy("s").agg(F.count("*").alias("members"), F.ceil(length / (WORDS * BLOCK)).alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high"))
        return materialise(now.join(split.where("low < high").drop("low", "high"), "s"), "apart")

    rows = apart()
    heavy = F.col("members") > LIGHT
    crowded = materialise(rows.where(heavy).select("set_id").distinct(), "crowded")
    whole = whole_sets(crowded, docs, keys, shingle)
    sketches = sketched(whole)
    spent += [crowded, whole, sketches]
    for _ in range(ROUNDS):
        pairs = materialise(block_pairs(rows.where(heavy), sketches, every=False), "closest")
        found = similar(pairs, whole.join(ends(pairs), "set_id", "left_semi"))
        spent += [pairs, found]
        if found.isEmpty():
            break
        links = links.union(found)
        discard(rows)
        rows = apart()
    rest = confirmed(cross_pairs(rows.where(~heavy)).union(block_pairs(rows.where(heavy), sketches, every=True)).distinct(), docs, keys, shingle)
    out = materialise(links.union(rest), "links")
    discard(*spent, rows, rest)
    return out


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """One row (set_id, first_id, root) per distinct set of docs (doc_id: an orderable value that isn't null, text)."""
    grouped = sets(docs, shingle).groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    first = materialise(grouped, "distinct-sets")
    links = similar_links(first, docs, shingle)
    out = materialise(first.select("set_id", "first_id").join(roots(links), "set_id", "left").select("set_id", "first_id", F.coalesce("above", "set_id").alias("root")), "rooted")
    discard(first, links)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, component_id: the smallest doc_id that is reachable over texts whose sets of shingles
    have a Jaccard similarity of at least 4/5, itself included.

    Null, empty and blank texts have equal sets. A null doc_id counts as larger than any other. Texts of rows that repeat a doc_id may
    differ: each row stands for itself. An empty table gives an empty result; columns may have any names.
    """
    keyed = docs.select(row_key(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rooted = _sets(keyed, shingle)
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("least"))
    named = rooted.select("set_id", "root").join(smallest, "root").select("set_id", F.col("least.doc_id").alias("component_id"))
    return sets(keyed, shingle).select("doc_id.doc_id", "set_id").join(named, "set_id").select("doc_id", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """The rows of docs of which one stays for each group of near duplicates: the one with the smallest id, null ids last, and of
    rows that share it the one with the smallest hash. Ids may be null or repeated: rows are told apart by all their columns. All
    columns come back as they were."""
    rooted = _sets(docs.select(row_key(docs, id_col).alias("doc_id"), F.col(text_col).alias("text")), shingle)
    return one_of_each(docs, rooted.groupBy("root").agg(F.min("first_id").alias("key")), id_col)
