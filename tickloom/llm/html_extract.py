"""Main text of web pages: what the markup settles, and a suffix array over each host's token streams for the rest.

A page is parsed once, in linear time, into blocks with a hint from the markup: CONTENT (inside article or main), DROPPED (inside a menu,
header, footer, sidebar, form, script, hidden element, or a container whose class names an advert, comments and the like), and three that
leave the question open: LIKELY (a page without article or main), SOFT (inside an element whose class or id only hints at boilerplate) and
BESIDE (outside of the article or main that the page has). Class and id words never drop an article, main, heading or paragraph.

Open blocks go to the array. The tokens of a page's open blocks are one stream, and every suffix of every stream of a host is sorted by its
first `depth` tokens: suffixes with equal beginnings meet by hash of host and tokens, whatever task read their pages, so the result does not
depend on how pages are dealt or on the size of a host. A beginning that at least MIN_PAGES distinct streams have, and one in SHARE of the
host's, is a long substring repeated across distinct pages, and the tokens that it covers are boilerplate. A block of which at least half
the tokens are covered goes. What remains are the unique runs: LIKELY blocks stay; SOFT blocks, and BESIDE paragraphs on hosts of MIN_PAGES
streams or more, stay if they are as long as the array can see (`depth` tokens), otherwise the hint decides and they go.

Only open blocks are dealt, one row a token; a substring that very many pages have is counted before it is dealt.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialise

DEPTH, MIN_PAGES, SHARE = 8, 3, 4
#: Element names of HTML, and words that sites use in class, id and role.
OUTSIDE = frozenset("nav header footer aside form noscript template button select svg object canvas dialog menu head audio video map datalist".split())
RAW = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead title tr ul".split())
MAIN = frozenset(["article", "main"])
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
NEVER = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertisements sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments disqus reply replies footer pagination".split())
HINTS = frozenset("promo promotion banner notice notices alert popup modal overlay masthead widget widgets toolbar pager hidden skip".split())
MODIFIERS = frozenset("no not has with without is".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Of each element the open ones that its start tag ends, and where the search for them stops.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ENDS = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dd": ("dd dt", {"dl"}), "dt": ("dd dt", {"dl"}), "option": ("option", {"select", "datalist"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"})}

NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s=>/][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?|=)")
TOKEN = re.compile(r"[A-Za-z0-9]+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

CONTENT, LIKELY, SOFT, BESIDE, DROPPED = range(5)
Block = tuple[int, str, bool]


def _named(value: str, words: frozenset[str]) -> bool:
    """One of the names in a class or id has one of the words, unless it begins with a modifier (no-sidebar, has-comments)."""
    return any(parts[0] not in MODIFIERS and not words.isdisjoint(parts) for parts in map(TOKEN.findall, value.split()) if parts)


def hint_of(name: str, attributes: dict[str, str], parent: int) -> int:
    """What the markup says about an element inside one with the parent's hint; LIKELY where it says nothing."""
    if parent == DROPPED or name in OUTSIDE and not (name == "header" and parent == CONTENT):
        return DROPPED
    hint = CONTENT if name in MAIN and parent != SOFT else parent
    if attributes and name not in ("html", "body"):
        role = attributes.get("role", "").lower()
        if role in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").lower().replace(" ", ""):
            return DROPPED
        if role in MAIN or attributes.get("itemprop", "").lower() == "articlebody":
            hint = CONTENT
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
        if name not in NEVER and not names.isspace():
            if _named(names, BOILERPLATE):
                return SOFT if name == "p" else DROPPED
            if _named(names, HINTS):
                return SOFT
    return hint


def attributes_at(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a start tag from behind its name, and the place of its end; -1 if the page ends before."""
    found: dict[str, str] = {}
    while (m := ATTRIBUTE.match(page, at)) is not None:
        if m[1]:
            found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        at = m.end()
    return found, page.find(">", at)


def blocks(page: str | None) -> list[Block]:
    """(hint, text, whether it is a paragraph or heading) of the blocks of a page in order, without the dropped ones."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, int]] = []  # elements that shape blocks or change the hint
    names: Counter[str] = Counter()
    held: list[str] = []
    hint, at, has_main = LIKELY, 0, False

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text and hint != DROPPED:
                out.append((hint, text, any(n in TEXTUAL for n, _ in stack[-2:])))

    def end(k: int) -> None:
        """Ends the open elements from place k on."""
        nonlocal hint
        if any(n in BLOCK for n, _ in stack[k:]):
            flush()
        for n, _ in stack[k:]:
            names[n] -= 1
        del stack[k:]
        hint = stack[-1][1] if stack else LIKELY

    def end_nearest(which: list[str], stops: set[str] | frozenset[str]) -> None:
        if any(names[n] > 0 for n in which):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in which:
                    return end(k)
                if stack[k][0] in stops:
                    return None
        return None

    while (start := page.find("<", at)) >= 0:
        if hint != DROPPED and start > at:
            held.append(page[at:start])
        follows = page[start + 1 : start + 2]
        if follows == "!" or follows == "?":
            close, width = ("-->", 3) if page.startswith("<!--", start) else ("]]>", 3) if page.startswith("<![CDATA[", start) else (">", 1)
            stop = page.find(close, start + 2)
            if stop < 0:
                at = len(page)
                break
            at = stop + width
            continue
        closing = follows == "/"
        m = NAME.match(page, start + 1 + closing)
        if m is None:  # no tag: a plain character, or a bogus comment
            at = start + 1
            if closing:
                stop = page.find(">", start)
                at = stop + 1 if stop >= 0 else len(page)
            elif hint != DROPPED:
                held.append("<")
            continue
        name, at = m[0].lower(), m.end()
        if page[at : at + 1] == ">":
            attributes: dict[str, str] = {}
            stop = at
        else:
            attributes, stop = attributes_at(page, at)
        if stop < 0:  # the page ends within a tag
            at = len(page)
            break
        alone, at = page[stop - 1] == "/", stop + 1
        if closing:
            if names[name] > 0:
                end(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            elif name in ("p", "br"):
                flush()
            continue
        if name in ENDS_P:
            end_nearest(["p"], {"table", "button", "object"})
        if name in ENDS:
            end_nearest(ENDS[name][0].split(), ENDS[name][1])
        if name == "body" and names["head"] > 0:  # a head that wasn't closed
            end(next(k for k, (n, _) in enumerate(stack) if n == "head"))
        if name in BLOCK:
            flush()
        elif name in ("br", "td", "th") and hint != DROPPED:
            held.append(" ")
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in VOID or alone and name in ("svg", "object", "canvas"):
            continue
        inside = hint_of(name, attributes, hint)
        has_main = has_main or inside == CONTENT
        if name in BLOCK or inside != hint:
            if inside != hint and inside != DROPPED and hint != DROPPED:
                flush()
            if inside == DROPPED and name in BLOCK:
                flush()
            stack.append((name, inside))
            names[name] += 1
            hint = inside
    else:
        if hint != DROPPED:
            held.append(page[at:])
    flush()
    return [(BESIDE if has_main and h == LIKELY else h, t, p) for h, t, p in out]


def tokens(found: list[Block]) -> list[bytes]:
    """The token stream of the open blocks."""
    return [w.encode() for h, t, _ in found if h != CONTENT for w in t.split(" ")]


def suffixes(host: str, stream: list[bytes], depth: int) -> np.ndarray:
    """A hash of host and first `depth` tokens of each suffix that is long enough, in order."""
    if len(stream) < depth:
        return np.zeros(0, np.int64)
    size = np.fromiter(map(len, stream), np.int64, len(stream))
    stop = np.cumsum(size + 1) - 1
    joined, seed = b" ".join(stream), xxhash.xxh32_intdigest(host)
    rows = b"".join([xxhash.xxh3_64_digest(joined[a:b], seed) for a, b in zip((stop - size)[: len(stream) - depth + 1].tolist(), stop[depth - 1 :].tolist(), strict=True)])
    return np.frombuffer(rows, ">i8").astype(np.int64)


def chosen(found: list[Block], repeated: list[int], streams: int, depth: int) -> tuple[str, int, int]:
    """(main text, tokens of the open blocks, covered ones), given where repeated suffixes begin and how many streams the host has."""
    total = sum(len(t.split(" ")) for h, t, _ in found if h != CONTENT)
    marks = np.zeros(total + 1, np.int64)
    for at in repeated:
        marks[at] += 1
        marks[min(at + depth, total)] -= 1
    upto = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
    kept, start = [], 0
    for hint, text, paragraph in found:
        if hint == CONTENT:
            kept.append(text)
            continue
        n = len(text.split(" "))
        unique = 2 * (upto[start + n] - upto[start]) < n
        start += n
        if unique and (hint == LIKELY or n >= depth and (hint == SOFT or paragraph and streams >= MIN_PAGES)):
            kept.append(text)
    return "\n".join(kept), total, int(upto[-1])


_PARSED = "row long, page_id {}, url string, host string, stream long, blocks array<struct<hint: int, text: string, paragraph: boolean>>"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", depth: int = DEPTH) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points), n_tokens (of the blocks that the markup leaves open) and n_covered
    (those that the suffix array found repeated).

    Null and empty pages and pages without main text have text "". Pages with a null or odd url form a host of their
    own. Repeated rows come out each; equal streams count as one page of a host. Unclosed elements end with
    their parents; a tag that is cut off at the end of the page is dropped. Extra columns are left out.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    kept = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1)).alias("host"))
    struct = pa.list_(pa.struct([("hint", pa.int32()), ("text", pa.string()), ("paragraph", pa.bool_())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(x.as_py()) for x in batch.column(2)]
            stream = [xxhash.xxh3_64_intdigest(b" ".join(words)) - 2**63 if (words := tokens(f)) else None for f in found]
            rows = pa.array([[{"hint": h, "text": t, "paragraph": p} for h, t, p in f] for f in found], struct)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(stream, pa.int64()), rows], ["page_id", "url", "host", "stream", "blocks"])

    def plain(rows: list[dict]) -> list[Block]:
        return [(b["hint"], b["text"], b["paragraph"]) for b in rows]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, host, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = suffixes(host, tokens(plain(found)), depth)
                first = np.zeros(len(w), bool)
                first[np.unique(w, return_index=True)[1]] = True
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), row)), pa.array([host] * len(w), pa.string()), pa.array(w), pa.array(np.arange(len(w), dtype=np.int32)), pa.array(first)], ["row", "host", "w", "at", "first"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chosen(plain(b), at or [], n or 0, depth) for b, at, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _, _ in found], pa.string()), *(pa.array(x, pa.int64()) for x in ([len(t) for t, _, _ in found], [n for _, n, _ in found], [c for _, _, c in found]))], ["page_id", "url", "text", "n_chars", "n_tokens", "n_covered"])

    made = kept.mapInArrow(parse, _PARSED.format(kind).replace("row long, ", ""))
    parsed = materialise(made.withColumn("row", F.monotonically_increasing_id()), "pages")
    open_ = parsed.where("stream IS NOT NULL")
    single = open_.groupBy("host", "stream").agg(F.min("row").alias("row"))  # of equal streams one is counted
    hosts = materialise(single.groupBy("host").agg(F.count("*").alias("streams")), "hosts")
    suffix = materialise(open_.select("row", "host", "blocks").mapInArrow(spread, "row long, host string, w long, at int, first boolean"), "suffixes")
    counted = suffix.where("first").join(single.select("row"), "row", "left_semi").groupBy("host", "w").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    repeated = counted.join(hosts, "host").where(SHARE * F.col("n") >= F.col("streams")).select("host", "w")
    covered = suffix.join(repeated, ["host", "w"], "left_semi").groupBy("row").agg(F.collect_list("at").alias("starts"))
    joined = parsed.join(covered, "row", "left").join(hosts, "host", "left")
    return joined.select("page_id", "url", "blocks", "starts", "streams").mapInArrow(finish, f"page_id {kind}, url string, text string, n_chars long, n_tokens long, n_covered long")
