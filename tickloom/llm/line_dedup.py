"""Near-duplicate lines by a deletion-neighbourhood join. DataFrame functions only.

A line is its words; lines without words are left alone. Lines with equal words are copies: the earliest stays (by document,
null first, and line number). Two lines of at least MIN_WORDS words are near duplicates if one word inserted, deleted or replaced
turns one into the other (so four fifths of the words or more are equal). Of near duplicates the earlier stays: a
line goes if an earlier distinct line lies within the bound.

Two such lines have an equal first or an equal last half (the half of the shorter one). So each distinct line first
gives at most four hashed half keys, and only lines that share one with another line are looked at again. Those are cut into
SEGMENTS parts, with a key for all words outside of each part: the edit lies in a part for which the key is shared. The line itself and the
line without its i-th word, for every i of such a part, are then emitted as 128-bit hashes (the other variants can equal none of another line).
Equal variants are joined. Lines that are equal without their i-th words are near duplicates if i is the same (replaced); a line that equals another
without a word is one (inserted or deleted). So a group of equal variants needs no pairs: its earliest line per i, its earliest line with a
deletion and its whole line, which are aggregates that sum up before rows are dealt, tell each member its earliest partner. The partner is then
verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import BLANKS, materialise

MIN_WORDS, SEGMENTS = 5, 8
_TRIM = " \t\n\x0b\x0c\r"


def _hash(w: Column) -> list[Column]:
    return [F.xxhash64(w).alias("h"), F.xxhash64(F.lit(1), w).alias("g")]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(place: document, hash of its text, line number; line, trimmed) of all lines with words."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = own.select("doc_id", F.xxhash64("text").alias("doc"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    out = out.select(F.struct("doc_id", "doc", "no").alias("place"), F.btrim("line", F.lit(_TRIM)).alias("line"))
    return out.where("line <> ''")


def _words(line: Column) -> Column:
    return F.split(line, f"[{BLANKS}]+")


def _half_keys(w: Column) -> list[Column]:
    """Hashes of the first and last halves, for a partner of as many words and, where that differs, for one that is a word shorter."""
    n = F.size(w)
    key = lambda side, k: F.xxhash64(F.lit(side), k, F.slice(w, F.lit(1) if side == 0 else n - k + 1, k))
    whole, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    long, even = n >= MIN_WORDS, (n > MIN_WORDS) & (n % 2 == 0)
    return [F.when(long, key(0, whole)).alias("k0"), F.when(long, key(1, whole)).alias("k1"), F.when(even, key(0, less)).alias("k2"), F.when(even, key(1, less)).alias("k3")]


def _segments(w: Column) -> Column:
    """(key, first, last) of each part, for a partner of as many words or one more (m = n) and for one of a word less (m = n - 1)."""
    n = F.size(w)

    def part(m: Column, s: Column) -> Column:
        start, end = F.floor(s * m / SEGMENTS).cast("int"), F.floor((s + 1) * m / SEGMENTS).cast("int")
        key = F.xxhash64(m, s, F.slice(w, F.lit(1), start), F.slice(w, n - m + end + 1, m - end))
        return F.struct(key.alias("key"), start.alias("first"), F.least(end, n - 1).alias("last"))

    parts = F.sequence(F.lit(0), F.lit(SEGMENTS - 1))
    shorter = F.when(n > MIN_WORDS, F.transform(parts, lambda s: part(n - 1, s))).otherwise(F.slice(F.transform(parts, lambda s: part(n, s)), 1, 0))
    return F.concat(F.transform(parts, lambda s: part(n, s)), shorter)


def _variants(w: Column, first: Column, last: Column) -> Column:
    """(i, h, g) of the line without its i-th word, for i from first to last."""
    rest = lambda i: (F.slice(w, F.lit(1), i), F.slice(w, i + 2, F.size(w)))
    return F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("i"), F.xxhash64(*rest(i)).alias("h"), F.xxhash64(F.lit(1), *rest(i)).alias("g")))


def within_one(a: Column, b: Column) -> Column:
    """Whether one word inserted, deleted or replaced makes the arrays equal."""
    longer, shorter = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    same = F.zip_with(longer, shorter, lambda x, y: x.eqNullSafe(y))
    at = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(shorter)).cast("int")
    tail = F.slice(longer, at + 2, F.size(longer))
    return (F.size(longer) == F.size(shorter)) & (tail == F.slice(shorter, at + 2, F.size(shorter))) | (F.size(longer) == F.size(shorter) + 1) & (tail == F.slice(shorter, at + 1, F.size(shorter)))


def near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The distinct lines (place of the earliest) and, of those, the places of lines with an earlier near duplicate
    (place, partner)."""
    half = ["k0", "k1", "k2", "k3"]
    keyed = _lines(docs, id_col, text_col).select("place", _words(F.col("line")).alias("w")).select("place", *_hash(F.col("w")), *_half_keys(F.col("w")))
    distinct = materialise(keyed.groupBy("h", "g").agg(F.min("place").alias("place"), *[F.min(k).alias(k) for k in half]).drop("g"), "distinct-lines")
    by_key = distinct.select("h", F.explode(F.array(*half)).alias("key")).where("key IS NOT NULL")
    shared = by_key.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    chosen = by_key.join(shared, "key", "left_semi").select("h").distinct()
    chosen = materialise(distinct.join(chosen, "h", "left_semi").select("place"), "candidate-places")
    # the candidates grow with the lines: one plan at every size, without a broadcast
    found = _lines(docs, id_col, text_col).join(chosen.hint("merge"), "place", "left_semi")
    texts = materialise(found.select("place", _words(F.col("line")).alias("w")).dropDuplicates(["place"]), "candidate-lines")
    parts = texts.select("place", F.explode(_segments(F.col("w"))).alias("p")).select("place", "p.*")
    equal = parts.groupBy("key").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("key")
    spots = materialise(parts.join(equal, "key", "left_semi").select("place", "first", "last").distinct(), "spots")
    cut = texts.join(spots, "place").select("place", F.explode(_variants(F.col("w"), F.col("first"), F.col("last"))).alias("v")).select("place", "v.*")
    whole = texts.join(spots.select("place").distinct(), "place", "left_semi").select("place", F.lit(-1).alias("i"), *_hash(F.col("w")))
    variant = materialise(cut.union(whole), "variants")
    by_i = variant.groupBy("h", "g", "i").agg(F.min("place").alias("least"), F.max("place").alias("latest"))
    group = by_i.groupBy("h", "g").agg(F.min(F.when(F.col("i") < 0, F.col("least"))).alias("whole"), F.min(F.when((F.col("i") >= 0), F.col("least"))).alias("cut"), F.bool_or((F.col("i") >= 0) & (F.col("least") != F.col("latest"))).alias("same"))
    group = materialise(group.where("same OR whole IS NOT NULL AND cut IS NOT NULL").drop("same"), "groups")
    some = materialise(variant.join(group, ["h", "g"]), "members")
    same_i = some.where("i >= 0").groupBy("h", "g", "i").agg(F.min("place").alias("replaced"))
    met = some.join(same_i, ["h", "g", "i"], "left").select("place", F.least(F.when(F.col("i") < 0, F.col("cut")).otherwise(F.col("whole")), F.col("replaced")).alias("partner"))
    pairs = met.where("partner < place").groupBy("place").agg(F.min("partner").alias("partner"))
    a, b = texts.select("place", F.col("w").alias("w1")), texts.select(F.col("place").alias("partner"), F.col("w").alias("w2"))
    near = pairs.join(a, "place").join(b, "partner").where(within_one(F.col("w1"), F.col("w2"))).select("place", "partner")
    return distinct.select("place"), near


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc: hash of the text, kept: sorted numbers, from 0, of the lines with words that stay)."""
    distinct, near = near_lines(docs, id_col, text_col)
    stay = distinct.join(near.select("place"), "place", "left_anti")
    return stay.select("place.doc_id", "place.doc", "place.no").groupBy("doc_id", "doc").agg(F.sort_array(F.collect_list("no")).alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines taken out of the texts; everything else as it was. Blank lines stay.

    Null texts stay null. Rows with one id and one text are one document and come out alike; an empty table gives an empty result;
    columns may have any names.
    """
    kept = kept_lines(docs, id_col, text_col).select(F.col("doc_id").alias("__tl_id"), F.col("doc").alias("__tl_doc"), F.col("kept").alias("__tl_kept"))
    joined = docs.join(kept, F.col(id_col).eqNullSafe(F.col("__tl_id")) & (F.xxhash64(F.col(text_col)) == F.col("__tl_doc")), "left")
    stays = lambda line, no: ~line.rlike(f"[^{BLANKS}]") | F.coalesce(F.array_contains(F.col("__tl_kept"), no), F.lit(False))
    return joined.withColumn(text_col, F.array_join(F.filter(F.split(text_col, "\n"), stays), "\n")).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines (with words), n_kept, kept_lines (numbers, comma-joined)."""
    own = docs.select("doc_id", F.xxhash64("text").alias("doc"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))).cast("long").alias("n_lines"))
    kept = kept_lines(docs).withColumnsRenamed({"doc_id": "k_id", "doc": "k_doc"})
    out = own.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("doc") == F.col("k_doc")), "left")
    kept_ = F.coalesce("kept", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(kept_).cast("long").alias("n_kept"), F.array_join(kept_.cast("array<string>"), ",").alias("kept_lines"))


ORACLE = r"""
WITH l AS (SELECT doc_id, no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) no FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT w, min([doc_id, no]) place FROM l GROUP BY w),
c AS (SELECT w, place, i, list_concat(list_slice(w, 1, i - 1), list_slice(w, i + 1, len(w))) v FROM (SELECT w, place, unnest(range(1, len(w) + 1)) i FROM d WHERE len(w) >= 5)),
n AS (SELECT a.place FROM c a JOIN c b ON a.v = b.v AND a.i = b.i WHERE b.place < a.place UNION SELECT a.place FROM c a JOIN d b ON a.v = b.w WHERE b.place < a.place AND len(b.w) >= 5 UNION SELECT b.place FROM c a JOIN d b ON a.v = b.w WHERE a.place < b.place AND len(b.w) >= 5),
k AS (SELECT place[1] doc_id, place[2] no FROM d ANTI JOIN n USING (place))
SELECT doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_kept, 0) n_kept, coalesce(kept_lines, '') kept_lines
FROM documents LEFT JOIN (SELECT doc_id, count(*) n_lines FROM l GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) n_kept, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) kept_lines FROM k GROUP BY doc_id) USING (doc_id)
"""
