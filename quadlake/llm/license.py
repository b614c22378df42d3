"""License scans by ordered signature rules, with DataFrame functions only.

A text is lower-cased (A-Z) and cut to words. Each rule (``license_rules``) is a regular expression with a
keyword, one word that every match has. The keywords are the prefilter: a text is searched only at places of
keywords, each rule only at places of its own, in a line of the ``LEFT`` words before the place and the
``RIGHT`` words from it on, which is more than any rule spans. A rule has one match at a place of its
keyword at most, an interval of words. An interval that lies within another of a higher rank (priority, then
length, then order of the rules) is suppressed. What is left gives the labels and the score.

Containment is found in one pass over the intervals in order of their starts: those that hold an interval
begin at most ``LEFT + RIGHT`` words before it, and are among the entries before it, of which
no more are looked at than can begin so near.

Beside the rules, base phrases are counted at every place and never suppressed.

Each row is worked on by itself: there is no shuffle, and the rules are one literal of the plan. Work grows with
the number of keyword places, not with its square.

Defined results: null text is empty (no words, no labels, score 0); repeated rows and null
ids are answered each; extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.llm.common import text_of
from quadlake.llm.license_rules import MARK, rules

BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Phrase -> label; each phrase is two or more words.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

LEFT, RIGHT = 20, 20
#: Entries of an array of intervals, of different bounds, that begin within LEFT + RIGHT words of each other.
NEAR = (8, 64, 512, (LEFT + RIGHT) ** 2)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def keywords() -> list[str]:
    """The rules' keywords, each once. A text holds one of them, or no rule can match it."""
    return list(dict.fromkeys(r[1] for r in rules()))


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rules() -> Column:
    """The rules by keyword, as one literal."""
    by: dict[str, list] = {}
    for n, (label, keyword, priority, confidence, rx) in enumerate(rules()):
        by.setdefault(keyword, []).append({"n": n, "label": label, "priority": priority, "confidence": confidence, "rx": f"(?<= ){rx}(?= )"})
    text = json.dumps([{"keyword": k, "rules": r} for k, r in by.items()])
    return F.from_json(F.lit(text), "array<struct<keyword: string, rules: array<struct<n: int, label: string, priority: int, confidence: double, rx: string>>>>")


def _lower(text: Column) -> Column:
    """A-Z in lower case. Of other characters only the Kelvin sign becomes one of A-Z by ``lower``; changes of
    the others touch neither the words' places nor any phrase or rule, which are of A-Z."""
    return F.when(F.contains(text, F.lit("\u212a")), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _line(words: Column, i: Column) -> Column:
    """The words around place i, with the mark before it."""
    before = F.array_join(F.slice(words, F.greatest(i - LEFT, F.lit(0)) + 1, F.least(i, F.lit(LEFT))), " ")
    return F.concat(F.lit(" "), before, F.when(i > 0, " ").otherwise(""), F.lit(MARK), F.array_join(F.slice(words, i + 1, RIGHT), " "), F.lit(" "))


def _matches(rule: Column, lines: Column) -> Column:
    """Intervals of a rule's matches in the lines of its keyword's places."""
    found = F.transform(lines, lambda x: F.struct(x["i"].alias("i"), F.regexp_substr(x["line"], rule["rx"]).alias("hit")))

    def interval(x: Column) -> Column:
        start = x["i"] - _spaces(F.substring_index(x["hit"], MARK, 1))
        return F.struct(start.alias("s"), (-(start + _spaces(x["hit"]) + 1)).alias("minus_e"), (-rule["priority"]).alias("minus_priority"), rule["n"].alias("n"), rule["confidence"].alias("confidence"), rule["label"].alias("label"))

    return F.transform(F.filter(found, lambda x: x["hit"].isNotNull()), interval)


def _higher(b: Column, a: Column) -> Column:
    """Whether b suppresses a, which does not begin before it: a lies within b, and b ranks above it."""
    rank = lambda x: F.struct(-x["minus_priority"], -x["minus_e"] - x["s"], -x["n"])
    return (b["minus_e"] <= a["minus_e"]) & (rank(b) > rank(a))


def _kept(intervals: Column) -> Column:
    """The intervals that none of a higher rank holds."""
    # In order; of equal intervals the first ranks highest, and the others lie within it.
    first = lambda all_: F.filter(all_, lambda x, k: (k == 0) | (F.get(all_, k - 1)["s"] != x["s"]) | (F.get(all_, k - 1)["minus_e"] != x["minus_e"]))

    def sweep(all_: Column) -> Column:
        near = lambda w: F.forall(F.transform(all_, lambda x, k: (k < w) | (x["s"] - F.get(all_, k - w)["s"] > LEFT + RIGHT)), lambda ok: ok)
        bound = F.lit(NEAR[-1])
        for w in reversed(NEAR[:-1]):
            bound = F.when(near(w), w).otherwise(bound)
        return _let(bound, lambda w: F.filter(all_, lambda x, k: ~F.exists(F.slice(all_, F.greatest(k - w, F.lit(0)) + 1, F.least(k, w)), lambda b: _higher(b, x))))

    return _let(F.array_sort(intervals), lambda sorted_: _let(first(sorted_), sweep))


def _detections(words: Column, places: Column) -> Column:
    own = lambda group: F.filter(places, lambda i: F.get(words, i) == group["keyword"])
    lines = lambda group: F.transform(own(group), lambda i: F.struct(i.alias("i"), _line(words, i).alias("line")))
    here = lambda there: F.filter(_rules(), lambda group: F.array_contains(there, group["keyword"]))
    groups = _let(F.array_distinct(F.transform(places, lambda i: F.get(words, i))), here)
    found = F.transform(groups, lambda group: _let(lines(group), lambda x: F.flatten(F.transform(group["rules"], lambda rule: _matches(rule, x)))))
    return _kept(F.flatten(found))


def _base(words: Column, places: Column) -> Column:
    """Starts and labels of the base phrases, whose first words are keywords."""
    def label(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, name in BASE.items():
            hit = F.lit(True)
            for j, word in enumerate(phrase.split()):
                hit = hit & F.coalesce(F.get(words, i + j) == word, F.lit(False))
            out = F.when(hit, name).otherwise(out)
        return out

    return F.filter(F.transform(places, lambda i: F.struct(i.cast("long").alias("i"), label(i).alias("label"))), lambda x: x["label"].isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (starts and labels of base phrases), detections (kept intervals: first word, end,
    label, confidence) of every text."""
    first = {p.split()[0] for p in BASE}
    known = sorted({*keywords(), *first})
    rows = docs.select("doc_id", F.trim(F.regexp_replace(_lower(text_of()), BETWEEN, " ")).alias("line"))
    rows = rows.select("doc_id", F.when(F.col("line") == "", F.array().cast("array<string>")).otherwise(F.split("line", " ")).alias("words"))
    place = lambda words: F.filter(F.transform(words, lambda w, i: F.when(w.isin(known), i)), lambda i: i.isNotNull())

    def found(words: Column) -> Column:
        """Count, base and detections, with the words and the places computed once."""
        def by_place(places: Column) -> Column:
            base, hits = _base(words, places), _detections(words, places)
            hits = F.transform(hits, lambda x: F.struct(x["s"].alias("s"), (-x["minus_e"]).alias("e"), x["label"].alias("label"), x["confidence"].alias("confidence")))
            return F.struct(F.size(words).cast("long").alias("n_words"), F.when(F.size(places) > 0, base).alias("base"), F.when(F.size(places) > 0, hits).alias("detections"))

        return _let(place(words), by_place)

    rows = rows.select("doc_id", _let(F.col("words"), found).alias("found"))
    return rows.select("doc_id", "found.n_words", F.coalesce("found.base", F.array()).alias("base"), F.coalesce("found.detections", F.array()).alias("detections"))


def license_labels(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every text."""
    rows = scan(docs)
    starts = F.transform("base", lambda b: b["i"])
    own, found = F.transform("base", lambda b: b["label"]), F.transform("detections", lambda d: d["label"])
    text = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    score = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)), F.when(F.size(own) > 0, F.lit(0.8)).otherwise(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        text(own).alias("base_labels"), text(F.concat(own, found)).alias("labels"), score.alias("score"),
    )
