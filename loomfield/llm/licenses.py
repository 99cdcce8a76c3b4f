"""License scans: a positional index of rare licence words, with DataFrame functions only.

Base labels are places of fixed phrases. The method adds labels of licence templates: over all documents the job counts in
how many each licence word stands; each template's `ANCHORS` words of highest inverse document frequency, with their
positions, form the index. All of a file's anchor words are looked up, so that a file may hold any number of notices, and
every pair of a file position and a posting of a template whose mandatory phrases the file holds votes for the template at
their distance. A template is found where at least `VOTES`
different words, and a third of its anchors, agree on one distance and the text also holds the template's mandatory phrases. score: the largest share
of a found template's anchors that agree; at least 0.5 with any base label; else 0. A template of one licence's whole text
and one of its notice bear the same label; words that stand between two words of a template, such as names in a notice,
move the rest to another distance, where those behind agree among themselves.

Words are lower-cased (A-Z) runs without ASCII punctuation. Null text is empty. Very long texts are scanned whole. Rows are
scanned one by one, so null or repeated doc_ids are no special case and tied rows fare alike; words of equal frequency are
ranked by themselves. An empty table gives an empty result. Columns that aren't asked for are ignored, whatever their names. Templates are a parameter of fixed size, so the index may be broadcast; what the
documents bring to the joins are only anchor words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, written
from .licence_texts import TEMPLATES

ANCHORS, VOTES = 8, 2

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
def words_of(text: Column) -> Column:
    """The text's words with one blank before, between and behind; one blank if there are none."""
    spaced = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(F.length(spaced) > 0, F.concat(F.lit(" "), spaced, F.lit(" "))).otherwise(F.lit(" "))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _holds(phrase: str) -> Column:
    return F.contains("words", F.lit(f" {phrase} "))


def _places(phrase: str) -> tuple[Column, Column, Column]:
    """(number, first word, last word) of a phrase's places."""
    number = F.when(_holds(phrase), F.regexp_count("words", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0).cast("long")
    first = F.when(_holds(phrase), _blanks(F.substring_index("words", f" {phrase} ", 1)))
    behind = F.length(F.substring_index("words", f" {phrase} ", -1)) + len(phrase) + 2
    last = F.when(_holds(phrase), _blanks(F.substring(F.col("words"), F.lit(1), F.length("words") - behind)))
    return number, first.cast("long"), last.cast("long")


def scan(docs: DataFrame, columns: list[str], templates: list[tuple[str, str, list[str]]] = TEMPLATES) -> DataFrame:
    """A struct `doc` of the columns, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, words, _ in templates for w in words.split()})
    places = {phrase: _places(phrase) for phrase in BASE}
    entry = F.transform(F.split(F.trim(F.col("words")), " "), lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    some = F.lit(False)
    for _, _, phrases in templates:
        some = some | _holds(phrases[0])
    # No template is found without its mandatory phrases, but document frequencies come from all documents.
    seen = F.array_distinct(F.filter(F.split(F.col("words"), " "), lambda w: w.isin(vocabulary)))
    src = docs.select(F.struct(*columns).alias("doc"), words_of(F.col("text")).alias("words"))
    rows = written(src.select(
        F.monotonically_increasing_id().alias("row"), "doc",
        F.when(F.col("words") == " ", 0).otherwise(_blanks(F.col("words")) - 1).cast("long").alias("n_words"),
        sum((p[0] for p in places.values()), F.lit(0).cast("long")).alias("n_base"),
        F.least(*(p[1] for p in places.values())).alias("first_word"),
        F.greatest(*(p[2] for p in places.values())).alias("last_word"),
        F.array_compact(F.array(*(F.when(_holds(phrase), F.lit(label)) for phrase, label in BASE.items()))).alias("base"),
        F.array_compact(F.array(*(F.when(_all([_holds(p) for p in phrases]), F.lit(k)) for k, (_, _, phrases) in enumerate(templates)))).alias("verified"),
        F.when(some, F.filter(entry, lambda x: x["word"].isin(vocabulary))).alias("hits"),
        seen.alias("seen"),
    ))
    total = rows.count()
    found = {r["word"]: r["n"] for r in rows.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each licence word
    idf = {w: math.log((total + 1) / (found.get(w, 0) + 1)) for w in vocabulary}
    postings = []
    for k, (_, words, _) in enumerate(templates):
        order = words.split()
        anchors = sorted(set(order), key=lambda w: (-idf[w], w))[:ANCHORS]
        postings += [(w, k, i, len(anchors)) for i, w in enumerate(order) if w in anchors]
    index = F.broadcast(spark.createDataFrame(postings, "word string, template int, place int, anchors int"))
    hits = rows.where("size(verified) > 0").select("row", "verified", F.explode("hits").alias("hit")).select("row", "verified", "hit.at", "hit.word")
    kept = hits.join(index, "word").where(F.array_contains("verified", F.col("template")))
    votes = kept.groupBy("row", "template", "anchors", (F.col("at") - F.col("place")).alias("shift")).agg(F.count_distinct("word").alias("votes"))
    best = votes.where(F.col("votes") >= F.least(F.greatest(F.lit(VOTES), F.ceil(F.col("anchors") / 3)), F.col("anchors"))).groupBy("row", "template").agg(F.max(F.col("votes") / F.col("anchors")).alias("share"))
    agreed = best.groupBy("row").agg(F.collect_list(F.struct("template", "share")).alias("agreed"))
    label_of = F.array(*(F.lit(label) for label, _, _ in templates))
    out = rows.join(agreed, "row", "left").withColumn("agreed", F.filter(F.coalesce("agreed", F.array().cast("array<struct<template:int,share:double>>")), lambda x: F.array_contains("verified", x["template"])))
    more = F.transform("agreed", lambda x: F.element_at(label_of, x["template"] + 1))
    share = F.coalesce(F.array_max(F.transform("agreed", lambda x: x["share"])), F.lit(0.0))
    return out.select(
        "doc", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", more))), ",").alias("labels"),
        F.greatest(share, F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), ["doc_id"]).select("doc.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
