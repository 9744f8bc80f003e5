"""Personal data: candidate spans, boosted trees, calibrated thresholds, redaction.

High-recall generators propose spans, which may overlap: every number, address or key that has roughly the shape of an e-mail
address (written plainly or with "at" and "dot"), an IPv4 or IPv6 address, a card, phone, social security or account
number, or an access key. The spans that the base rules accept are always redacted. Boosted trees judge the other
candidates by features of format (lengths, classes, checksums, grouping) and of context (words before, characters on
both sides); a span is added if its calibrated probability reaches its kind's threshold, which is the lowest with the
wanted precision on held-out examples, and it overlaps no base span and no likelier one.

The trees are trained on the driver on `examples` generated examples (4,000 unless told otherwise; the bound of the sample) of true and false spans in
invented context with a fixed seed; no text of the corpus is used, so results don't depend on the corpus' size.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.boosting import BoostedTrees

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "ipv6", "secret", "ssn")
EXAMPLES, PRECISION = 4_000, 0.99

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?: ?[0-9]|-[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """The base rules: kind by kind as listed, by start."""
    out: list[Span] = [("email", *x) for x in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


#: Generators: kind, what a text must contain for it (one of these), pattern, group that is the span.
_GENERATORS = (
    ("email", ("at)", "at]", "at}", "AT)", "AT]", "AT}", "At)", "At]", "At}", " at ", " AT ", " At "), re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{1,63}){1,5}", re.I), 0),
    ("card", None, re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"), 0),
    ("phone", None, re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"), 0),
    ("ssn", None, re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"), 0),
    ("account", None, re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"), 0),
    ("ipv6", (":",), re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])"), 0),
    ("secret", ("=", ":"), re.compile(r"(?<![A-Za-z])([A-Za-z_]{2,24})[\"']? ?[=:] ?[\"']?([A-Za-z0-9+/_-]{16,})(?![A-Za-z0-9+/_-])"), 2),
)

#: Words that announce a kind.
_CUES = {"email": ("mail", "contact", "write"), "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "call", "tel", "mobile", "fax"), "ssn": ("ssn", "social", "security"), "account": ("iban", "account", "bank", "konto"), "ipv6": ("ip", "host", "address", "ipv6"), "secret": ("token", "key", "secret", "password", "passwd", "auth", "bearer", "credential")}
_CONTEXT = 32


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int


def candidates(text: str) -> list[Candidate]:
    """All proposals, overlapping ones too."""
    out, digits = [], None
    for kind, needs, pattern, group in _GENERATORS:
        if needs is None or kind in ("ipv6", "secret"):
            digits = bool(_DIGIT.search(text)) if digits is None else digits
            if not digits:
                continue
        if needs is None or any(n in text for n in needs):
            out += [Candidate(kind, *m.span(group)) for m in pattern.finditer(text)]
    return out


def mod97(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, c: Candidate) -> list[float]:
    span = text[c.start : c.end]
    digits = _digits(span)
    letters = sum(x.isalpha() for x in span)
    before = text[max(0, c.start - _CONTEXT) : c.start].lower()
    left, right = text[c.start - 1 : c.start], text[c.end : c.end + 1]
    counts = Counter(span)
    entropy = -sum(n / len(span) * math.log2(n / len(span)) for n in counts.values())
    ssn = len(digits) == 9 and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    return [
        float(KINDS.index(c.kind)), len(span), len(digits), letters / len(span), sum(x.isupper() for x in span) / len(span), entropy, len(counts) / len(span),
        float(luhn(digits)) if digits else 0.0, float(c.kind == "account" and mod97(span)), float(ssn), float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", span))),
        sum(not x.isalnum() for x in span), float(any(q in before for q in _CUES[c.kind])), float(left.isalnum()), float(right.isalnum()), float(left in "\"'"),
        float(bool(re.search(r"\(at\)|\[at\]|\{at\}", span, re.I))), float(bool(re.search(r"\(dot\)|\[dot\]|\{dot\}", span, re.I))), float(digits[:1] in ("3", "4", "5", "6")),
        float(bool(digits) and len(set(digits)) <= 2), float("::" in span or span.count(":") == 7), float(bool(re.search(r"[a-z][A-Z]|[A-Za-z][0-9]|[0-9][A-Za-z]", span))),
    ]


def example(rnd: random.Random) -> tuple[str, Candidate, int] | None:
    """A text, a candidate in it, and whether it is personal data (or a key)."""
    word = lambda: "".join(rnd.choice("etaoinshrdlucmfw") for _ in range(rnd.randint(2, 9)))
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    kind = rnd.choice([g[0] for g in _GENERATORS])
    good = rnd.random() < 0.5
    cue = rnd.choice(_CUES[kind])
    if kind == "email":
        at, dot = rnd.choice(["(at)", "[at]", "{at}"]), rnd.choice(["(dot)", "[dot]", "{dot}"])
        local = f"{word()}{rnd.choice(['', '.' + word(), '_' + word(), '-' + word(), digits(2)])}"
        host, end = f"{word()}{rnd.choice(['', '-' + word(), digits(1)])}", rnd.choice(["com", "org", "net", "de", "fr", "edu", "info"])
        gap = rnd.choice(["", " "])
        span = (f"{local}{gap}{at}{gap}{host}{gap}{dot}{gap}{end}" if rnd.random() < 0.6 else f"{local}{gap}{at}{gap}{host}.{end}") if good else f"{word()} at {word()} dot {word()}"
        cue = cue if good and rnd.random() < 0.5 else ""
    elif kind == "card":
        body = rnd.choice("3456" if good else "0123456789") + digits(rnd.choice([12, 13, 14]) if good else rnd.randint(11, 17))
        check = [c for c in "0123456789" if luhn(body + c) == (good or rnd.random() < 0.1)]
        span = body + rnd.choice(check)
        cue = cue if rnd.random() < 0.8 and (good or not luhn(span)) else ""
        good = good and bool(cue) or good and 16 <= len(span) <= 19
        span = rnd.choice(["", " ", "-"]).join(span[k : k + 4] for k in range(0, len(span), 4))
    elif kind == "phone":
        span = rnd.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(digits(3), digits(3), digits(4))
        cue = cue if good else ""
    elif kind == "ssn":
        span = f"{digits(3)}-{digits(2)}-{digits(4)}"
        area = span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"
        cue = cue if good or not area else ""
        good = good and area
    elif kind == "account":
        body = rnd.choice(["DE", "FR", "ES", "GB", "NL"]) + "00" + digits(rnd.choice([14, 16, 18, 20, 21]))
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        span = body[:2] + f"{check if good else (check + rnd.randint(1, 90)) % 97:02d}" + body[4:]
        span = rnd.choice(["", " "]).join(span[k : k + 4] for k in range(0, len(span), 4))
        cue = cue if rnd.random() < 0.5 else ""
    elif kind == "ipv6":
        group = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.randint(1, 4)))
        short = ":".join(group() for _ in range(rnd.randint(2, 4))) + "::" + ":".join(group() for _ in range(rnd.randint(1, 3)))
        other = [f"{rnd.randint(0, 23):02d}:{digits(2)}:{digits(2)}", ":".join(str(rnd.randint(1, 99)) for _ in range(rnd.randint(3, 5))), ":".join("".join(rnd.choice("0123456789abcdef") for _ in range(2)) for _ in range(6))]
        span = (":".join(group() for _ in range(8)) if rnd.random() < 0.5 else short) if good else rnd.choice(other)
        cue = cue if good and rnd.random() < 0.5 else ""
    else:
        alphabet = rnd.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
        body = "".join(rnd.choice(alphabet) for _ in range(rnd.choice([20, 24, 32, 40, 64])))
        name = cue if good else rnd.choice(["commit", "sha", "checksum", "id", "version", "class", word()])
        span = body if good or rnd.random() < 0.5 else "-".join(word() for _ in range(4))
        quote = rnd.choice(['"', "'", ""])
        text = f"{word()} {word()} {name}{rnd.choice([' = ', '=', ': '])}{quote}{span}{quote} {word()}."
        start = text.index(span)
        found = [c for c in candidates(text) if c.kind == kind and c.start == start]
        return (text, found[0], int(good)) if found else None
    text = " ".join([word(), word(), *([cue + rnd.choice(["", ":"])] if cue else []), span, word() + rnd.choice(["", ".", ","]), word()])
    start = text.index(span)
    found = [c for c in candidates(text) if c.kind == kind and c.start < start + len(span) and c.end > start]
    return (text, found[0], int(good)) if found else None


@cache
def model(examples: int = EXAMPLES, precision: float = PRECISION, seed: int = 11) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees trained on half of the examples, calibrated on a quarter, with thresholds from the last quarter."""
    rnd = random.Random(seed)
    rows: list[tuple[str, Candidate, int]] = []
    while len(rows) < examples:
        if (one := example(rnd)) is not None:
            rows.append(one)
    x = np.array([features(t, c) for t, c, _ in rows])
    y = np.array([g for _, _, g in rows], float)
    half, rest = examples // 2, 3 * examples // 4
    trees = BoostedTrees().fit(x[:half], y[:half]).calibrate(x[half:rest], y[half:rest])
    p, truth = trees.probability(x[rest:]), y[rest:]
    kind = np.array([c.kind for _, c, _ in rows[rest:]])
    threshold = {}
    for k in dict.fromkeys(g[0] for g in _GENERATORS):
        own = kind == k
        choices = [t for t in np.unique(p[own]) if t >= 0.5 and truth[own & (p >= t)].mean() >= precision]
        threshold[k] = float(choices[0]) - 1e-9 if choices else 2.0
    return trees, threshold


def spans_of(texts: list[str], trees: BoostedTrees, threshold: dict[str, float]) -> list[list[Span]]:
    """All spans of each text: base ones by kind and start, then the added ones; of a kind by start."""
    base = [base_spans(t) for t in texts]
    proposed, rows, where = [], [], []
    for k, t in enumerate(texts):
        if not t:
            continue
        taken = sorted((a, b) for _, a, b in base[k])
        starts = [a for a, _ in taken]
        ends = list(np.maximum.accumulate([b for _, b in taken])) if taken else []
        for c in candidates(t):
            j = bisect_right(starts, c.end - 1)
            if not (j and ends[j - 1] > c.start):
                proposed.append(c)
                rows.append(features(t, c))
                where.append(k)
    p = trees.probability(np.array(rows)) if rows else []
    added: dict[int, list[Candidate]] = {}  # of each text in order, without overlaps
    for i in sorted(range(len(rows)), key=lambda i: (where[i], -p[i], proposed[i].start)):
        c, own = proposed[i], added.setdefault(where[i], [])
        if p[i] >= threshold[c.kind]:
            j = bisect_left(own, c.end, key=lambda o: o.start)
            if not j or own[j - 1].end <= c.start:
                own.insert(j, c)
    out = []
    for k, found in enumerate(base):
        more = [(c.kind, c.start, c.end) for c in added.get(k, [])]
        out.append(sorted(found + more, key=lambda s: (KINDS.index(s[0]), s[1])))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES, precision: float = PRECISION) -> DataFrame:
    """One row per row of docs: doc_id, base and spans (arrays of kind, start, end; code points, end exclusive), and
    redacted: the text with [KIND] in place of every span.

    Null texts count as empty and have no spans. Repeated rows come out each; an empty table gives an empty result;
    extra columns are left out. Whole texts are scanned, whatever their length.
    """
    return _scan(docs, id_col, text_col, examples, precision, True)


def redact(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(docs: DataFrame, id_col: str, text_col: str, examples: int, precision: float, full: bool) -> DataFrame:
    trees, threshold = model(examples, precision)
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = kept.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    struct = lambda rows: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], span)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            found = spans_of(texts, trees, threshold)
            base = [base_spans(t) if f else [] for t, f in zip(texts, found, strict=True)]
            if full:
                columns = [batch.column(0), struct(base), struct(found), pa.array([redact(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "spans", "redacted"])
            else:
                counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in BASE]
                sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([joined(f) for f in found], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    schema = "base array<struct<kind: string, start: bigint, end: bigint>>, spans array<struct<kind: string, start: bigint, end: bigint>>, redacted string" if full else ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return kept.mapInArrow(scan, f"doc_id {id_type}, {schema}")


def query(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all, joined)."""
    return _scan(docs, "doc_id", "text", EXAMPLES, PRECISION, False)
