"""Licence scan with ordered signature rules; DataFrame operations only, no shuffle.

A document is lower-cased (A-Z) and reduced to words. Documents without any trigger word only have their words counted. In the others the
rules whose keyword occurs run over the normalised words. Matches are sorted by place; one that lies inside another match of equal or
better priority is suppressed, in one pass that carries the furthest end per priority.

Defined results: NULL text counts as empty; a text without words has 0 words, no labels ('') and score 0; NULL ids and repeated rows pass through
row by row; other columns are ignored. The work per document grows with its own length and number of matches only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import whole_text
from wearline.llm.license_rules import BASE, LEVELS, Rule, rules, triggers

#: ASCII without letters and digits. Listed one by one, as the regex engine looks single characters up in a bit set but walks through ranges.
OTHERS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
#: What stands between words, whatever their case.
GAP = f"[{OTHERS}]+"


def plain_words(text: Column) -> Column:
    """The words with one space between them."""
    return F.trim(F.regexp_replace(text, GAP, " "))


def word_text(plain: Column) -> Column:
    """`plain_words` in lower case (A-Z) with one space before and after each."""
    return F.concat(F.lit(" "), F.translate(plain, string.ascii_uppercase, string.ascii_lowercase), F.lit(" "))


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def places(words: Column, regex: Column) -> Column:
    """(start, end) in words, end exclusive, of every match of a regex over `word_text`."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + _spaces(pair["piece"])
        end = begin + _spaces(pair["match"])
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end")))).alias("found"))

    def located(matches: Column) -> Column:
        pairs = F.arrays_zip(matches.alias("match"), F.slice(F.split(words, regex, -1), F.lit(1), F.size(matches)).alias("piece"))
        return F.when(F.size(matches) == 0, start["found"]).otherwise(F.aggregate(pairs, start, step, lambda s: s["found"]))

    return _let(F.regexp_extract_all(words, regex, F.lit(0)), located)


def rule_table(table: list[Rule]) -> Column:
    """The rules by keyword: array<struct<keyword, rules>>."""
    by_keyword: dict[str, list[Column]] = {}
    for r in table:
        rule = F.struct(F.lit(r.label).alias("label"), F.lit(r.regex).alias("regex"), F.lit(r.weight).alias("weight"), F.lit(r.priority).alias("priority"))
        by_keyword.setdefault(f" {r.keyword} ", []).append(rule)
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*v).alias("rules")) for k, v in by_keyword.items()])


def detections(words: Column, table: list[Rule]) -> Column:
    """Every match of a rule whose keyword occurs, sorted by start, longer first, then priority and label."""

    def matched(rule: Column) -> Column:
        return F.transform(places(words, rule["regex"]), lambda m: F.struct(
            m["start"].alias("start"), (-m["end"]).alias("minus_end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["weight"].alias("weight")))

    gated = F.filter(rule_table(table), lambda g: F.contains(words, g["keyword"]))
    return F.array_sort(F.flatten(F.transform(F.flatten(F.transform(gated, lambda g: g["rules"])), matched)))


def unsuppressed(found: Column) -> Column:
    """The detections that do not lie inside one of equal or better priority."""
    none = F.struct(*[F.lit(-1).alias(f"p{i}") for i in range(LEVELS)], F.slice(found, 1, 0).alias("kept"))

    def step(state: Column, d: Column) -> Column:
        end = -d["minus_end"]
        reach = F.greatest(*[F.when(F.lit(i) <= d["priority"], state[f"p{i}"]).otherwise(F.lit(-1)) for i in range(LEVELS)])
        ends = [F.when((d["priority"] == i) & (end > state[f"p{i}"]), end).otherwise(state[f"p{i}"]).alias(f"p{i}") for i in range(LEVELS)]
        return F.struct(*ends, F.when(reach >= end, state["kept"]).otherwise(F.concat(state["kept"], F.array(d))).alias("kept"))

    return F.aggregate(found, none, step, lambda s: s["kept"])


def _labelled(found: Column, label: str) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(label).alias("label"), m["start"].alias("start")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, base (label and place of every base phrase) and spans (the detections that stay) of every row."""
    table = rules() if table is None else table
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    lowered = F.lower("text")
    gate = F.lit(False)
    for trigger in triggers(table):  # single words, so that what stands between words does not matter
        gate = gate | F.contains(lowered, F.lit(trigger))
    rows = rows.select("doc_id", plain_words(F.col("text")).alias("plain"), gate.alias("gate"))
    n_words = F.when(F.col("plain") == "", 0).otherwise(_spaces(F.col("plain")) + 1)
    rows = rows.select("doc_id", n_words.cast("long").alias("n_words"), F.when(F.col("gate"), word_text(F.col("plain"))).alias("words"))
    words = F.col("words")
    base = F.flatten(F.array(*[_labelled(places(words, F.lit(f" {phrase}(?= )")), label) for phrase, label in BASE]))
    return rows.select("doc_id", "n_words", F.when(words.isNotNull(), base).alias("base"), F.when(words.isNotNull(), detections(words, table)).alias("found")).select(
        "doc_id", "n_words", "base", unsuppressed(F.col("found")).alias("spans")
    )


def summary(scanned: DataFrame) -> DataFrame:
    """The digest of `scan`: one row per document."""
    starts = F.transform("base", lambda b: b["start"])
    base_labels = F.coalesce(F.transform("base", lambda b: b["label"]), F.array().cast("array<string>"))
    own_labels = F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["weight"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("_n"), starts.alias("_starts"), base_labels.alias("_b"), own_labels.alias("_o"), best.alias("_best"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
    ).select(
        "doc_id", "n_words", F.greatest("_n", F.lit(0).cast("long")).alias("n_base"),
        F.array_min("_starts").cast("long").alias("first_word"), F.array_max("_starts").cast("long").alias("last_word"),
        joined(F.col("_b")).alias("base_labels"), joined(F.concat("_b", "_o")).alias("labels"),
        F.when(F.col("_n") > 0, F.greatest("_best", F.lit(0.7))).otherwise(F.col("_best")).alias("score"), F.greatest("n_spans", F.lit(0).cast("long")).alias("n_spans"),
    )
