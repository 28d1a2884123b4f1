"""The license scan against a plain version in Python, and its rules one by one."""

import random
import re
import re._parser as sre
import time

import pytest

from xancestry.llm import licenses
from xancestry.llm.license_rules import STEMS, rules

DOCS = "doc_id long, text string, found string, `Words` int, said int"
LICENSE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
TEXTS = [
    None, "", " ", "no signature here", "Released under the MIT License.", "MIT\n\n-- license", "mit licenses", "submit license", "MITKLicense mitélicense",
    LICENSE, "GNU Lesser General Public License version 2.1 or later", "either version 3 of the GNU General Public License, or (at your option) any later version", "Licensed under CC BY-NC 4.0.",
    "general public license general public license", "Creative Commons Attribution-ShareAlike 4.0 International License", "All rights reserved. " * 30 + "Copyright 2020 Foo Bar. All rights reserved.",
    ("filler " * 510 + "MIT License ") * 3, "word " * 495 + LICENSE + " tail" * 600, "mit license " * 700, "\x00MIT\x7fLICENSE\x00", "CC0 1.0 Universal", "do what the fuck you want to public licence",
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(text):
    """(n_words, [(start, end, label, rank, rule)]): every rule at every word, without keywords, stems or blocks."""
    w = words(text)
    out = []
    said, at = " ".join(w) + " ", 0
    for i, word in enumerate(w):
        for s in licenses.signatures():
            if m := re.compile(f"({s['pattern']}) ").match(said, at):
                out.append((i, i + 1 + m[1].count(" "), s["label"], s["rank"], s["rule"]))
        at += len(word) + 1
    better = lambda y, x: y[0] <= x[0] and y[1] >= x[1] and 0 < y[3] and 0 < x[3] and (y[3] < x[3] or y[3] == x[3] and (y[1] - y[0] > x[1] - x[0] or y[1] - y[0] == x[1] - x[0] and y[4] < x[4]))
    return len(w), sorted(x for x in out if not any(better(y, x) for y in out if y[0] <= x[0] and y[1] >= x[1]))


def test_against_every_rule_at_every_word(spark):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)] + [(None, "MIT license", None, None, None), (4, TEXTS[4], None, None, None)]
    out = licenses.detect(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "n_words", "found"]
    got = sorted(((r["doc_id"], r["n_words"], [tuple(f) for f in r["found"]]) for r in out.collect()), key=str)
    assert got == sorted(((r[0], *by_hand(r[1])) for r in rows), key=str)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_digest(spark):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in licenses.digest(licenses.detect(spark.createDataFrame(rows, DOCS))).collect()}
    for i, t in enumerate(TEXTS):
        n, found = by_hand(t)
        base = [f for f in found if f[3] == 0]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == ((min(f[0] for f in base), max(f[0] for f in base)) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({f[2] for f in base})) and r["labels"] == ",".join(sorted({f[2] for f in found}))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(found)
    assert "apache-2.0" in got[9]["labels"] and got[9]["base_labels"] == "apache"
    assert got[10]["labels"] == "gpl,lgpl-2.1-or-later" and got[11]["labels"] == "gpl,gpl-3.0-or-later" and got[12]["labels"] == "cc-by-nc-4.0"
    empty = licenses.digest(licenses.detect(spark.createDataFrame([], DOCS)))
    assert empty.count() == 0 and empty.columns[0] == "doc_id"


def most_spaces(parsed):
    n = 0
    for op, av in parsed:
        kind = str(op)
        if kind == "LITERAL":
            n += av == 32
        elif kind == "MAX_REPEAT":
            inner = most_spaces(av[2])
            n += inner * av[1] if inner else 0
        elif kind == "SUBPATTERN":
            n += most_spaces(av[-1])
        elif kind == "BRANCH":
            n += max(map(most_spaces, av[1]))
    return n


def sample(parsed, rng):
    out = ""
    for op, av in parsed:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(av)
        elif kind == "NOT_LITERAL":
            out += "zq"
        elif kind == "MAX_REPEAT":
            out += "".join(sample(av[2], rng) for _ in range(rng.randint(av[0], min(av[1], av[0] + 3))))
        elif kind == "SUBPATTERN":
            out += sample(av[-1], rng)
        elif kind == "BRANCH":
            out += sample(rng.choice(av[1]), rng)
        elif kind == "IN":
            k, v = rng.choice(av)
            out += chr(v) if str(k) == "LITERAL" else chr(rng.randint(*v))
    return out


@pytest.mark.parametrize("at", range(0, len(rules()), 100))
def test_keywords_and_stems_lose_nothing(at):
    """Whatever a rule matches holds its keyword and a stem, has one space between words, and no more words than stand beside a block."""
    rng = random.Random(at)
    for r in rules()[at : at + 100]:
        parsed = sre.parse(r.pattern)
        assert most_spaces(parsed) < licenses.REACH and 1 <= r.rank <= 4 and len(r.label) > 1
        for _ in range(60):
            x = sample(parsed, rng)
            assert re.fullmatch(r.pattern, x) and r.keyword in x and any(s in x for s in STEMS) and "  " not in x and x == x.strip(), (r, x)


def test_long_texts_take_time_by_their_length(spark):
    """A text of nothing but detections."""
    took = []
    for n in (2000, 2000, 16000):
        d = spark.createDataFrame([(1, "mit license " * n)], "doc_id long, text string")
        began = time.time()
        (r,) = licenses.digest(licenses.detect(d)).collect()
        took.append(time.time() - began)
        assert (r["n_base"], r["first_word"], r["last_word"], r["n_words"]) == (n, 0, 2 * n - 2, 2 * n)
    assert took[2] < 30 * took[1] + 5
