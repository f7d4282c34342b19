"""License detection by ordered signature rules.

A text becomes its lower-case words, joined by single blanks. Rules (`license_rules`) are regular expressions over that
string, written by hand after notices, headers, titles, addresses and the phrases that refer to a license; each has a
priority and a keyword, and is tried on a text only where the text holds its keyword; a text that holds none of the short
anchors, one of which is in every keyword, is not tried at all. Neither drops a match. Detections are intervals of words.
One that lies within another of higher priority, or of equal priority and greater length, is suppressed; of equal intervals
the earlier rule's stays. Array functions do all of this within the row, so there is no shuffle.

Base phrases are counted beside the rules and always stay. A null text counts as empty: no words, no labels, score 0.
Repeated rows give repeated results. Very long texts are scanned whole. Other columns, whatever their names, are neither
read nor returned. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .license_rules import ANCHORS
from .license_rules import rules as signatures

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: What a text holds if any rule can match it: an anchor stands in every keyword, a keyword in every match.
GATE = "|".join(map(re.escape, ANCHORS))


def rules() -> list[tuple[int, str, int, float, str, str]]:
    """(number, label, priority, confidence, keyword, pattern), strongest first."""
    return [(k, *r) for k, r in enumerate(sorted(signatures(), key=lambda r: r[1]))]


def _spaces(c: str) -> str:
    return f"(length({c}) - length(replace({c}, ' ', '')))"


def normalized(text: Column) -> Column:
    """Lower-case words with a blank before each and after the last; only A-Z change to ASCII letters."""
    plain = F.when(text.rlike("[Kİ]"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(plain, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")), F.lit(" "))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (label, rule, start, end)."""
    d = docs.select("doc_id", normalized(text_or_empty()).alias("_t"))
    d = d.select("doc_id", "_t", F.when(F.col("_t") == "  ", 0).otherwise(F.expr(_spaces("_t")) - 1).cast("long").alias("n_words"))
    found = [F.when(F.contains("_t", F.lit(f" {p} ")), F.size(F.split("_t", f" {p}(?= )", -1)) - 1).otherwise(0) for p in PHRASES]
    first = [F.when(F.contains("_t", F.lit(f" {p} ")), F.expr(_spaces(f"substring(_t, 1, instr(_t, ' {p} ') - 1)"))) for p in PHRASES]
    last = [F.when(F.contains("_t", F.lit(f" {p} ")), F.expr(_spaces(f"substring(_t, 1, length(_t) - instr(reverse(_t), '{f' {p} '[::-1]}') - {len(p) + 1})"))) for p in PHRASES]
    names = F.array_sort(F.array_compact(F.array(*(F.when(F.contains("_t", F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items()))))
    total = found[0]
    for f in found[1:]:
        total = total + f
    by: dict[str, list[Column]] = {}
    for k, label, p, c, word, body in rules():
        by.setdefault(word, []).append(F.struct(F.lit(k).alias("rule"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(c).alias("confidence"), F.lit(f" (?:{body})(?= )").alias("pattern")))
    table = F.array(*(F.struct(F.lit(word).alias("keyword"), F.array(*r).alias("rules")) for word, r in by.items()))
    gate = F.contains("_t", F.lit(ANCHORS[0]))
    for x in ANCHORS[1:]:
        gate = gate | F.contains("_t", F.lit(x))
    d = d.select(
        "doc_id", "_t", "n_words",
        total.cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"),
        names.alias("_base"),
        F.when(gate, F.flatten(F.transform(F.filter(table, lambda r: F.contains(F.col("_t"), r["keyword"])), lambda r: r["rules"]))).alias("_rules"),
    )
    # For each rule the pieces between its matches and the matches; then the words before each match.
    d = d.withColumn("_m", F.expr("filter(transform(_rules, r -> struct(r.rule, r.label, r.priority, r.confidence, split(_t, r.pattern, -1) as pieces, regexp_extract_all(_t, r.pattern, 0) as found)), m -> size(m.found) > 0)"))
    d = d.withColumn("_m", F.expr(f"transform(_m, m -> struct(m.rule, m.label, m.priority, m.confidence, transform(m.pieces, x -> {_spaces('x')}) as gaps, transform(m.found, x -> {_spaces('x')}) as lengths))"))
    d = d.withColumn("_d", F.expr("flatten(transform(_m, m -> transform(m.lengths, (n, k) -> struct(aggregate(slice(m.gaps, 1, k + 1), 0, (a, x) -> a + x) + aggregate(slice(m.lengths, 1, k), 0, (a, x) -> a + x) as start, n as words, m.priority, m.rule, m.label, m.confidence))))"))
    d = d.withColumn("_k", F.expr("filter(_d, x -> not exists(_d, y -> y.rule <> x.rule and y.start <= x.start and y.start + y.words >= x.start + x.words and (y.priority < x.priority or y.priority = x.priority and (y.words > x.words or y.rule < x.rule))))"))
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce(F.expr("transform(_k, x -> x.label)"), F.array().cast("array<string>")))))
    return d.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.size("_base") > 0, 0.6).otherwise(0.0), F.coalesce(F.array_max(F.expr("transform(_k, x -> cast(x.confidence as double))")), F.lit(0.0))).alias("score"),
        F.expr("transform(_k, x -> struct(x.label, x.rule, x.start, x.start + x.words as end))").alias("detections"),
    )
