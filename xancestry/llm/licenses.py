"""License scan by ordered signature rules, with DataFrame functions only.

A text without any stem of the rules is read no further. Of the others, blocks of words with a stem are looked at, each with as many
words beside it as the longest rule has, so that blocks find what the whole text holds. In a block, a rule is tried where its
keyword occurs, and holds at every word at which its pattern matches. A detection inside a stronger one goes: one of a better
rank, or of the same rank and longer, or as long and of an earlier rule. All of it happens in the row: nothing is shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, exact, fresh
from .license_rules import STEMS, Rule, rules

#: A word of the lower-cased text, and of the text as it is.
WORD, RAW_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases whose places are all reported, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words of a block, and words beside it: no rule matches more.
BLOCK, REACH = 512, 32
#: How sure a detection of each rank is; rank 0 are the phrases.
SURE = {0: 0.8, 1: 0.95, 2: 0.9, 3: 0.7, 4: 0.3}
KIND = "array<struct<rule:int,label:string,rank:int,keyword:string,pattern:string>>"
STEM = "|".join(STEMS)
#: Stands before a word at which a rule holds; no word has it.
MARK = "\x01"


def signatures(by: list[Rule] | None = None) -> list[dict]:
    """The phrases, with rank 0 and numbers below zero, and the rules."""
    base = [{"rule": k - len(PHRASES), "label": label, "rank": 0, "keyword": p, "pattern": p} for k, (p, label) in enumerate(PHRASES.items())]
    return base + [{"rule": k, "label": r.label, "rank": r.rank, "keyword": r.keyword, "pattern": r.pattern} for k, r in enumerate(rules() if by is None else by)]


def _blocks(words: Column) -> Column:
    """(at, low, said): blocks with a stem, the first word of each, the first one that it was given, and its words between spaces."""
    n = F.ceil(F.size(words) / BLOCK).cast("int")

    def block(b):
        at = b * BLOCK
        low = F.greatest(at - REACH, F.lit(0))
        said = F.concat(F.lit(" "), F.array_join(F.slice(words, low + 1, at + BLOCK + REACH - low), " "), F.lit(" "))
        return F.struct(at.alias("at"), low.alias("low"), said.alias("said"))

    return F.filter(F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), block)), lambda b: b["said"].rlike(STEM))


def _places(block: Column, rule: Column) -> Column:
    """Every place at which the rule holds in the block, as words [start, end) of the text."""
    at = F.concat(F.lit("(?<= )(?=("), rule["pattern"], F.lit(") )"))
    marked = F.split(F.regexp_replace(block["said"], at, F.lit(MARK)), " ")
    # The first part stands before the first space, so a word's place is one less.
    starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith(MARK), i - 1)), lambda i: i.isNotNull())
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    put = lambda i, s: F.struct(
        (block["low"] + i).cast("long").alias("start"), (block["low"] + i + spaces(s) + 1).cast("long").alias("end"),
        rule["label"].alias("label"), rule["rank"].alias("rank"), rule["rule"].alias("rule"),
    )
    return F.zip_with(starts, F.regexp_extract_all(block["said"], at, F.lit(1)), put)


def _stronger(y: Column, x: Column) -> Column:
    """Whether y holds x within it and is the better one; phrases neither suppress nor are suppressed."""
    size = lambda d: d["end"] - d["start"]
    longer = (size(y) > size(x)) | ((size(y) == size(x)) & (y["rule"] < x["rule"]))
    return (y["rank"] > 0) & (x["rank"] > 0) & (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & ((y["rank"] < x["rank"]) | ((y["rank"] == x["rank"]) & longer))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: list[Rule] | None = None) -> DataFrame:
    """Scans every whole text.

    Returns id_col, n_words and found: an array of (start, end, label, rank, rule), the words [start, end) from 0, in order, of
    the phrases (rank 0, all places) and of the rules' detections that no stronger one holds. A null text counts as empty and has
    no words; nothing found is an empty array. Repeated rows give repeated results, a null id stays null, other columns
    are left out, and an empty table gives an empty one. The work in a block is bounded, so a text's grows with its length.
    """
    given = F.from_json(F.lit(json.dumps(signatures(by))), KIND)
    d = docs.select(exact(id_col).alias(id_col), F.coalesce(exact(text_col), F.lit("")).alias(said := fresh(docs.select(exact(id_col)), "said")))
    text, names = exact(said), iter(("words", "blocks", "n_words", "found"))
    words, blocks, n_words, found = (fresh(d, x) for x in names)
    told = text.rlike(f"(?i){STEM}")
    d = d.withColumn(words, F.when(told, F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))))
    d = d.select(exact(id_col), F.coalesce(F.size(words), F.regexp_count(text, F.lit(RAW_WORD))).cast("long").alias(n_words), _blocks(exact(words)).alias(blocks))

    def in_block(b):
        tried = F.filter(given, lambda r: F.contains(b["said"], r["keyword"]))
        every = F.flatten(F.transform(tried, lambda r: _places(b, r)))
        own = lambda x: (x["start"] >= b["at"]) & (x["start"] < b["at"] + BLOCK)
        # One array of a block's detections is compared with itself; transform gives it a name.
        return F.element_at(F.transform(F.array(every), lambda all_: F.filter(all_, lambda x: own(x) & ~F.exists(all_, lambda y: _stronger(y, x)))), 1)

    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string,rank:int,rule:int>>")
    hits = F.coalesce(F.array_sort(F.flatten(F.transform(exact(blocks), in_block))), none)
    return d.select(exact(id_col), exact(n_words).alias("n_words"), hits.alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels and score of what detect() found.

    The score is one less the product, over the ranks that occur, of how unsure each is; 0 where nothing was found.
    """
    base = F.filter("found", lambda x: x["rank"] == 0)
    starts = F.transform(base, lambda x: x["start"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    unsure = F.lit(1.0)
    for rank, sure in SURE.items():
        unsure = unsure * F.when(F.exists("found", lambda x: x["rank"] == rank), F.lit(1 - sure)).otherwise(F.lit(1.0))  # noqa: B023
    return found.select(
        exact(id_col), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("found")).alias("labels"), F.round(1 - unsure, 6).alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL: every rule at every word of the texts that have a stem."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({s['rule']}, {quoted(s['label'])}, {s['rank']}, {quoted(s['keyword'])}, {quoted(s['pattern'])})" for s in signatures())
    unsure = " * ".join(f"CASE WHEN bool_or(rank = {r}) THEN {1 - sure!r}::DOUBLE ELSE 1.0::DOUBLE END" for r, sure in SURE.items())
    return rf"""
WITH r AS (SELECT * FROM (VALUES {values}) t(rule, label, rank, keyword, pattern)),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
p AS (SELECT k, w, unnest(range(len(w))) AS i FROM d WHERE regexp_matches(array_to_string(w, ' '), '{STEM}')),
x AS (SELECT k, i, array_to_string(w[i + 1:i + {REACH}], ' ') || ' ' AS said FROM p),
m AS (SELECT k, i AS start, rule, label, rank, regexp_extract(said, '^(' || pattern || ') ', 1) AS got FROM x JOIN r ON contains(said, keyword) WHERE regexp_matches(said, '^(' || pattern || ') ')),
e AS (SELECT *, start + length(got) - length(replace(got, ' ', '')) + 1 AS end_ FROM m),
f AS (SELECT * FROM e x WHERE rank = 0 OR NOT EXISTS (SELECT 1 FROM e y WHERE y.k = x.k AND y.rank > 0 AND y.start <= x.start AND y.end_ >= x.end_ AND (y.rank < x.rank OR y.rank = x.rank AND
  (y.end_ - y.start > x.end_ - x.start OR y.end_ - y.start = x.end_ - x.start AND y.rule < x.rule)))),
g AS (SELECT k, count(*) FILTER (WHERE rank = 0) AS n_base, min(start) FILTER (WHERE rank = 0) AS first_word, max(start) FILTER (WHERE rank = 0) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE rank = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(1 - {unsure}, 6) AS score FROM f GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN g USING (k)"""
