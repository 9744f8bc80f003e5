import random
import re
import time

import pytest

from tickloom.llm import license_scan as ls

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("name", sorted(ls.TEMPLATES))
def test_every_template_is_found_alone(name):
    scanner = ls.Scanner(ls.TEMPLATES)
    text = f"Some prose.\n{ls.TEMPLATES[name]}\nMore prose."
    found = scanner.scan(text)
    assert [x["license"] for x in found] == [name]
    assert found[0]["missing"] == found[0]["extra"] == 0
    assert text[found[0]["start"] : found[0]["end"]].rstrip(".") == ls.TEMPLATES[name].rstrip(".")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under the Apache Licence, Version 2.0", ["Apache-2.0"]),
        ("This work is licensed under the GNU General Public License, version 4.", []),
        ("Licensed under CC BY-ND 4.0.", []),
        ("My driving license was renewed under the new rules.", []),
        ("x Released under the MIT License. y Licensed under CC BY-NC 4.0. z", ["MIT", "CC-BY-NC-4.0"]),
        ("", []),
    ],
)
def test_wording(text, want):
    assert [x["license"] for x in ls.Scanner(ls.TEMPLATES).scan(text)] == want


def test_ranking_puts_the_right_template_first():
    scanner = ls.Scanner(ls.TEMPLATES)
    for name, text in ls.TEMPLATES.items():
        assert scanner.rank(text)[0][1] == name


def altered(rnd, name, how):
    """The template with one word changed, dropped or added that is neither a name nor a number."""
    words = ls.TEMPLATES[name].split()
    free = [k for k, w in enumerate(words) if not any(x in ls.NAMES or any(c.isdigit() for c in x) for x, _, _ in ls.normal(w))]
    k = rnd.choice(free[:1] if how == "first" else free)
    new = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 12)))
    words[k : k + (how != "add")] = [] if how == "drop" else [new]
    return " ".join(words)


@pytest.mark.parametrize("name", sorted(ls.TEMPLATES))
def test_altered_statements_are_found_anywhere(name):
    """Recall over one changed, dropped or added word, the first one too, at any place of short and long lines."""
    rnd, scanner, lost, n = random.Random(len(name)), ls.Scanner(ls.TEMPLATES), [], 0
    for how in ("change", "drop", "add", "first"):
        for around in (0, 5, 60, 1500):
            for _ in range(4):
                prose = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randint(1, 9))) for _ in range(around)]
                at = rnd.randint(0, around)
                one = altered(rnd, name, how)
                text = " ".join([*prose[:at], one, *prose[at:]])
                found = scanner.scan(text)
                n += 1
                if name not in [x["license"] for x in found] and not (found and {x["license"] for x in found} <= {k for k in ls.TEMPLATES if k.split("-")[0] == name.split("-")[0]}):
                    lost.append((how, around, one[:90], [x["license"] for x in found]))
    assert len(lost) <= n // 20, lost


def test_compression_rejects_what_the_wording_need_not_see():
    """The gate leaves out most templates of a piece, and prose has none."""
    scanner = ls.Scanner(ls.TEMPLATES)
    passed = [sum(share >= ls.GATE for share, _ in scanner.rank(f"Some prose before. {t} And after.")) for t in ls.TEMPLATES.values()]
    assert sum(passed) < len(passed) ** 2 / 2
    assert not [x for x in scanner.rank("We warrant that the permit for this copyright was printed last year in the town of the river.") if x[0] >= ls.GATE]


def test_linear_in_cues():
    start = time.perf_counter()
    assert ls.Scanner(ls.TEMPLATES).scan("licence permit " * 4000) == []
    assert time.perf_counter() - start < 20


def test_test_table_equals_plain_search(spark):
    """The table's statements are whole lines."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {}
    for r in ls.scan(docs).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.license))
    want = {}
    for r in docs.collect():
        for name in ("Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0", "MIT"):
            for m in re.finditer(re.escape(ls.TEMPLATES[name]), r.text):
                want.setdefault(r.doc_id, []).append((m.start(), name))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()} and want


def test_edges(spark):
    assert ls.scan(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None), (2, ""), (None, "Released under the MIT License."), (3, "İ Released under the MIT License."), (4, "word " * 50_000 + "license"), (None, "Released under the MIT License.")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA + ", license int")
    assert sorted((r.doc_id or 0, r.license) for r in ls.scan(docs).collect()) == [(0, "MIT"), (0, "MIT"), (3, "MIT")]


@pytest.mark.parametrize("name", ["MIT", "Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0"])
def test_statement_in_a_long_line(name):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 9))) for _ in range(15_000)]
    text = " ".join(words[:7000]) + " " + ls.TEMPLATES[name] + " " + " ".join(words[7000:])
    assert len(text) > 100_000
    assert [(x["license"], x["missing"], x["extra"]) for x in ls.Scanner(ls.TEMPLATES).scan(text)] == [(name, 0, 0)]


@pytest.mark.parametrize("before", ["", "We moved this page to another server last year. ", "This is licensed. ", "Permission of this work is general. "])
def test_first_word_differs(before):
    text = before + "Our work is licensed under the GNU General Public License, version 3."
    found = ls.Scanner(ls.TEMPLATES).scan(text)
    assert [x["license"] for x in found] == ["GPL-3.0"] and text[found[0]["end"] - 9 : found[0]["end"]] == "version 3"
