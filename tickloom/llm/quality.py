"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame functions only.

Four whole numbers describe a text: `marks` (ASCII punctuation per thousand characters of words), `lines` (repeated lines per thousand),
`repeats` (words in repeated windows per thousand) and `length` (mean word length in hundredths of a character). A sketch is a histogram that
keeps the top seven bits of a value (so a quantile is off by less than 1/64), counts only, as rows (group, measure, bucket, count): sketches
merge by adding counts, in any order, with one result. They are built per language and source over the texts that pass the base rule, in one
aggregation, which sums up before rows are dealt, so a source with a third of all rows is no hot key, and merge to languages and to all rows.
In place of a fixed cutoff a text must lie below

    third quartile + SPREAD * (third quartile - first quartile) + SLACK

of each measure (for word length also above the mirrored bound), taken from the finest of the three levels that has seen `min_rows` values.
Most texts have no repeated line or window at all, so for these two the quartiles are those of the values above zero. SLACK only keeps a group
whose texts are all alike from having no room; quartiles hold against junk of up to a quarter of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import BLANKS, materialise, plain_words

MEASURES = ("marks", "lines", "repeats", "length")
ABOVE_ZERO = ("lines", "repeats")
SPREAD = {"marks": 4, "lines": 2, "repeats": 4, "length": 6}
SLACK, MIN_ROWS, WINDOW = 20, 200, 5


def features(docs: DataFrame, text_col: str = "text", *keep: Column) -> DataFrame:
    """The kept columns, n_words, word_chars, n_symbols, n_marks, n_lines (with a word), n_dup_lines and n_repeat_words of every whole text."""
    text = F.col("__tl_text")
    out = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__tl_text"))
    out = out.withColumns({"__tl_w": plain_words(text), "__tl_l": F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))})
    w, lines, count = F.col("__tl_w"), F.col("__tl_l"), lambda which: F.regexp_count(text, F.lit(which)).cast("long")
    out = out.withColumns({"n_words": F.size(w).cast("long"), "word_chars": F.length(F.array_join(w, "")).cast("long"), "n_symbols": count("[#*$%&|<>]"), "n_marks": count(r"[!-/:-@\[-`{-~]")})
    out = out.withColumns({"n_lines": F.size(lines).cast("long"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"), "__tl_h": F.transform(w, lambda x: F.xxhash64(x))})
    out = out.drop("__tl_text", "__tl_l", "__tl_w")
    h = F.col("__tl_h")
    shifted = F.arrays_zip(*[F.slice(h, k + 1, F.size(h) - WINDOW + 1).alias(f"w{k}") for k in range(WINDOW)])
    out = out.withColumn("__tl_g", F.when(F.size(h) > WINDOW, F.transform(shifted, lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>"))).drop("__tl_h")
    g = F.col("__tl_g")
    some = F.size(F.array_distinct(g)) < F.size(g)
    out = out.withColumn("__tl_s", F.when(some, F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))))).drop("__tl_g")
    s = F.col("__tl_s")
    twice = F.filter(s, lambda x, k: x["g"].eqNullSafe(F.get(s, k - 1)["g"]) | x["g"].eqNullSafe(F.get(s, k + 1)["g"]))
    out = out.withColumn("__tl_p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__tl_s")
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    union = F.aggregate(F.col("__tl_p"), start, lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")))["n"]
    return out.withColumn("n_repeat_words", F.coalesce(union, F.lit(0)).cast("long")).drop("__tl_p")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def _measures(rows: DataFrame) -> DataFrame:
    per = lambda a, b, k: F.floor(F.lit(k) * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return rows.withColumns({"marks": per("n_marks", "word_chars", 1000), "lines": per("n_dup_lines", "n_lines", 1000), "repeats": per("n_repeat_words", "n_words", 1000), "length": per("word_chars", "n_words", 100)})


def bucket(value: Column) -> Column:
    """The value with all but its top seven bits cleared."""
    low = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketch(rows: DataFrame, group: list[str]) -> DataFrame:
    """Sketches of the four measures: (group..., measure, bucket, n), of the rows that pass the base rule."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])
    counted = F.filter(pairs, lambda x: ~x["measure"].isin(*ABOVE_ZERO) | (x["bucket"] > 0))
    good = rows.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return good.select(*group, F.explode(counted).alias("__tl_m")).groupBy(*group, "__tl_m.measure", "__tl_m.bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, group: list[str]) -> DataFrame:
    return sketches.groupBy(*group, "measure", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketches: DataFrame, group: list[str], min_rows: int = MIN_ROWS) -> DataFrame:
    """Per group the upper bound of each measure and the lower bound of length; null where the measure has fewer than min_rows values."""
    by = Window.partitionBy(*group, "measure")
    run = F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = sketches.withColumn("seen", F.sum("n").over(by)).withColumn("upto", run).where(F.col("seen") >= min_rows)
    point = lambda num, den: F.min(F.when(F.lit(den) * F.col("upto") >= F.lit(num) * F.col("seen"), F.col("bucket")))
    q = placed.groupBy(*group, "measure").agg(point(1, 4).alias("q1"), point(3, 4).alias("q3"))
    wide = lambda m: F.lit(SPREAD[m]) * (F.col("q3") - F.col("q1")) + SLACK
    at = lambda m, v: F.max(F.when(F.col("measure") == m, v))
    return q.groupBy(*group).agg(*[at(m, F.col("q3") + wide(m)).alias(f"{m}_max") for m in MEASURES], at("length", F.col("q1") - wide("length")).alias("length_min"))


def judge(rows: DataFrame, lang_col: str = "lang", source_col: str = "source", min_rows: int = MIN_ROWS) -> DataFrame:
    """rows (with features) plus base_failed and kept."""
    rows = _measures(rows.withColumns({"__tl_lang": F.col(lang_col), "__tl_source": F.col(source_col)}))
    fine = materialise(sketch(rows, ["__tl_lang", "__tl_source"]), "sketches")
    bounds = [f"{m}_max" for m in MEASURES] + ["length_min"]
    level = lambda df, n: df.withColumnsRenamed({c: f"{c}{n}" for c in ("__tl_lang", "__tl_source")}).withColumnsRenamed({c: f"__tl_{c}{n}" for c in bounds})
    by_source = level(thresholds(fine, ["__tl_lang", "__tl_source"], min_rows), 2)
    by_lang = level(thresholds(merge(fine, ["__tl_lang"]), ["__tl_lang"], min_rows), 1)
    whole = merge(fine.withColumn("__tl_all", F.lit(1)), ["__tl_all"])
    by_all = level(thresholds(whole, ["__tl_all"], 1).drop("__tl_all"), 0)  # one row, or none
    out = rows.join(by_source, F.col("__tl_lang").eqNullSafe(F.col("__tl_lang2")) & F.col("__tl_source").eqNullSafe(F.col("__tl_source2")), "left")
    out = out.join(by_lang, F.col("__tl_lang").eqNullSafe(F.col("__tl_lang1")), "left").join(F.broadcast(by_all), F.lit(True), "left")
    b = {c: F.coalesce(*[f"__tl_{c}{n}" for n in (2, 1, 0)], F.lit(0)) for c in bounds}
    inside = F.col("length") >= b["length_min"]
    for m in MEASURES:
        inside = inside & (F.col(m) <= b[f"{m}_max"])
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    out = out.withColumns({"base_failed": failed, "kept": ~failed & inside})
    return out.drop(*[c for c in out.columns if c.startswith("__tl_")], *MEASURES)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null, empty and blank texts have zero of everything and fail the base. Null languages and sources are groups of
    their own. Repeated rows count and come out each. An empty table gives an empty result. Extra columns are left out.
    """
    rows = materialise(features(docs, text_col, F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")), "features")
    judged = judge(rows, min_rows=min_rows)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_rows: int = MIN_ROWS) -> DataFrame:
    """The rows of docs that the rules keep, with all columns as they were."""
    key = {"__tl_id": F.col(id_col), "__tl_hash": F.xxhash64(F.col(text_col))}
    rows = materialise(features(docs, text_col, *[v.alias(k.replace("__tl", "key")) for k, v in key.items()], F.col(lang_col).alias("lang"), F.col(source_col).alias("source")), "features")
    good = judge(rows, min_rows=min_rows).where("kept").select("key_id", "key_hash", "lang", "source").withColumnsRenamed({"lang": "key_lang", "source": "key_source"}).distinct()
    same = F.col(id_col).eqNullSafe(F.col("key_id")) & (F.xxhash64(F.col(text_col)) == F.col("key_hash")) & F.col(lang_col).eqNullSafe(F.col("key_lang")) & F.col(source_col).eqNullSafe(F.col("key_source"))
    return docs.join(good, same, "left_semi")


_FEATURES = r"""
d AS (SELECT row_number() OVER () r, doc_id, lang, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
li AS (SELECT r, count(*) n_lines, count(*) - count(DISTINCT l) n_dup FROM (SELECT r, unnest(string_split(t, chr(10))) l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
wi AS (SELECT r, p, list_slice(w, p, p + 4) g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) p FROM d WHERE len(w) > 4)),
tw AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) c FROM wi) WHERE c > 1),
re AS (SELECT r, count(DISTINCT q) n FROM (SELECT r, unnest(range(p, p + 5)) q FROM tw) GROUP BY r),
f AS (SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) n_words, CAST(length(array_to_string(w, '')) AS BIGINT) word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) n_symbols, CAST(length(t) - length(regexp_replace(t, '[!-/:-@\[-`{-~]', '', 'g')) AS BIGINT) n_marks, CAST(coalesce(n_lines, 0) AS BIGINT) n_lines, CAST(coalesce(n_dup, 0) AS BIGINT) n_dup_lines, CAST(coalesce(re.n, 0) AS BIGINT) n_repeat_words FROM d LEFT JOIN li USING (r) LEFT JOIN re USING (r))
"""


def oracle() -> str:
    """The query in DuckDB's SQL."""
    level = lambda name, cols, least: f"""
{name}s AS (SELECT {cols}, m, b, sum(n) n FROM k GROUP BY ALL),
{name}q AS (SELECT {cols}, m, min(CASE WHEN 4 * u >= s THEN b END) q1, min(CASE WHEN 4 * u >= 3 * s THEN b END) q3 FROM (SELECT *, sum(n) OVER (PARTITION BY {cols}, m) s, sum(n) OVER (PARTITION BY {cols}, m ORDER BY b) u FROM {name}s) WHERE s >= {least} GROUP BY ALL),
{name}t AS (SELECT {cols}, {', '.join(f"max(CASE WHEN m = '{m}' THEN q3 + {SPREAD[m]} * (q3 - q1) + {SLACK} END) {m}_max" for m in MEASURES)}, max(CASE WHEN m = 'length' THEN q1 - {SPREAD['length']} * (q3 - q1) - {SLACK} END) length_min FROM {name}q GROUP BY {cols})"""  # noqa: E731
    pick = lambda c: f"coalesce(a.{c}, l.{c}, z.{c}, 0)"
    tests = " AND ".join([*(f'x."{m}" <= {pick(f"{m}_max")}' for m in MEASURES), f"x.length >= {pick('length_min')}"])
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' m, \"{m}\" v FROM x WHERE NOT bf" + f' AND "{m}" > 0' * (m in ABOVE_ZERO) for m in MEASURES)
    return f"""WITH {_FEATURES.strip()},
x AS (SELECT *, 1000 * n_marks // greatest(word_chars, 1) marks, 1000 * n_dup_lines // greatest(n_lines, 1) "lines", 1000 * n_repeat_words // greatest(n_words, 1) repeats, 100 * word_chars // greatest(n_words, 1) length, n_words < 10 OR 100 * n_repeat_words > 20 * n_words bf FROM f),
k AS (SELECT lang, source, 1 one, m, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) b, count(*) n FROM ({values}) GROUP BY ALL),{level('ga', 'lang, source', MIN_ROWS)},{level('gl', 'lang', MIN_ROWS)},{level('gz', 'one', 1)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bf base_failed, NOT bf AND {tests} kept
FROM x LEFT JOIN gat a ON x.lang IS NOT DISTINCT FROM a.lang AND x.source IS NOT DISTINCT FROM a.source LEFT JOIN glt l ON x.lang IS NOT DISTINCT FROM l.lang LEFT JOIN gzt z ON true"""
