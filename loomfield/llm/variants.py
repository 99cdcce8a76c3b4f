"""Spelling variants: words one edit apart, found level by level along a trie that is a table of edges.

The trie of all words is one distributed edge table (parent, char, child, mask, ends): a node is the hash of its prefix,
`mask` the next characters as bits, `ends` whether a word ends there. The frontier holds states (a, b) of two nodes one edit
apart: `a` stands for every word and position with that prefix, `b` is the node that the trie has reached, the edit is
spent. A level joins the frontier with the edge table, for the character that follows in `a` and then for the same one at
`b`. New states are born beside it: two children of one node (a replaced character), and a child with its parent (a deleted
one, the mirror of an inserted one; of a run of equal characters the last counts as deleted, so each pair is reached once).
States without a next character in common are left out at birth. Where words end at both nodes, they are neighbours; both
words are then looked up and compared, so a node that two prefixes shared by their hash would be found out, and loses
nothing. A node has at most as many children as the alphabet, so no join is larger than that many rows for each state.

Words of `DEPTH` characters or more would need as many levels; they are linked, among themselves, by what is left without
one character: equal remainders at one place (replaced), or a remainder that is a word (deleted). That is exact as well.

Null text has no words, nor has an empty one; very long texts and words are taken whole. A null doc_id counts as the empty
text in the hash that picks deletions. Repeated rows count as often as they stand there. Ties of n between forms fall to the
smallest word in code-point order. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, documents, written

LEAST_LENGTH, LEAST_COUNT, FACTOR, DEPTH = 7, 2, 10, 40
FILES = 16  # of a level's edges
RUN = r"[A-Za-zÀ-ÿ]"
PICKED = 31


def _without(word: Column, place: Column) -> Column:
    """word without its character at place, from 0."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n: the distinct words of docs' texts with enough characters and occurrences, picked ones with a deletion."""
    runs = F.expr(f"regexp_extract_all(text, r'{RUN}{{{LEAST_LENGTH},}}', 0)")  # a deletion only shortens
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run"))
    low = rows.select("doc_id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    word = F.when(h % PICKED == 0, _without(F.col("run"), (h % F.length("run")).cast("int"))).otherwise(F.col("run"))
    return low.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _node(word: Column, depth: Column) -> Column:
    return F.xxhash64(F.substring(word, F.lit(1), depth))


def trie(words: DataFrame) -> DataFrame:
    """depth, parent, char, child, mask, ends of every edge of the trie of words(word)."""
    steps = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("depth"))
    after = F.substring("word", F.col("depth") + 1, F.lit(1))
    rows = steps.select(
        "depth", _node(F.col("word"), F.col("depth") - 1).alias("parent"), F.substring("word", F.col("depth"), F.lit(1)).alias("char"), _node(F.col("word"), F.col("depth")).alias("child"),
        F.when(after == "", F.lit(0).cast("long")).otherwise(_bit(after)).alias("mask"), (after == "").alias("ends"),
    )
    return rows.groupBy("depth", "parent", "char", "child").agg(F.bit_or("mask").alias("mask"), F.max("ends").alias("ends"))


def _bit(char: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(char) % 64)


def _frontier(edges: DataFrame, level: int, states: DataFrame | None) -> DataFrame:
    """a, b, mask (b's), bar, done of the states whose `a` has `level` characters."""
    here = edges.where(F.col("depth") == level)
    end = lambda name: [F.col(c).alias(f"{c}_{name}") for c in ("char", "child", "mask", "ends")]
    left, right = here.select("parent", *end("a")), here.select("parent", *end("b"))
    out = left.join(right, "parent").where("char_a > char_b").withColumn("bar", F.lit(None).cast("string"))
    # The parent's own mask and end stand in its edge one level up; the root has none: any character may follow, no word ends.
    if level > 1:
        above = edges.where(F.col("depth") == level - 1).select(F.col("child").alias("parent"), F.col("child").alias("child_b"), F.col("mask").alias("mask_b"), F.col("ends").alias("ends_b"))
        born = left.join(above, "parent")
    else:
        born = left.select("*", F.col("parent").alias("child_b"), F.lit(-1).cast("long").alias("mask_b"), F.lit(False).alias("ends_b"))
    names = ["child_a", "mask_a", "ends_a", "child_b", "mask_b", "ends_b", "bar"]
    out = out.select(*names).unionByName(born.withColumn("bar", F.col("char_a")).select(*names))
    if states is not None:
        ahead = states.join(left.withColumnRenamed("parent", "a"), "a").where((F.col("bar").isNull() | (F.col("bar") != F.col("char_a"))) & (F.col("mask").bitwiseAND(_bit(F.col("char_a"))) != 0))
        other = edges.where(F.col("depth").isin(level - 1, level)).select(F.col("parent").alias("b"), *end("b"))
        ahead = ahead.drop("bar", "mask").join(other.withColumnRenamed("char_b", "char_a"), ["b", "char_a"]).withColumn("bar", F.lit(None).cast("string"))
        out = out.unionByName(ahead.select(*names))
    done = F.col("ends_a") & F.col("ends_b")
    open_ = F.col("mask_a").bitwiseAND(F.col("mask_b")) != 0
    return out.where(done | open_).select(F.col("child_a").alias("a"), F.col("child_b").alias("b"), F.col("mask_b").alias("mask"), "bar", done.alias("done"), open_.alias("open"))


def neighbours(words: DataFrame) -> DataFrame:
    """word, other of every unordered pair of words(word) exactly one edit apart, once."""
    short = words.where(F.length("word") <= DEPTH).select("word")
    edges = written(trie(short).repartition("depth", F.pmod("child", F.lit(FILES))), "depth")
    found, states, level, levels = None, None, 1, []
    deepest = edges.agg(F.max("depth")).first()[0] or 0
    while level <= deepest:
        now = written(_frontier(edges, level, states))
        levels.append(now)
        pairs = now.where("done").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        states = now.where("open").select("a", "b", "mask", "bar")
        level += 1
    named = short.select(F.xxhash64("word").alias("node"), "word")
    out = None
    if found is not None:
        out = found.join(named.toDF("a", "word"), "a").join(named.toDF("b", "other"), "b").where(F.levenshtein("word", "other") == 1).select("word", "other")
    pairs = _long_pairs(words) if out is None else out.unionByName(_long_pairs(words))
    result = written(pairs)
    discard(edges, *levels)
    return result


def _long_pairs(words: DataFrame) -> DataFrame:
    """The pairs in which both words have at least DEPTH characters, but those of the trie."""
    long_ = words.where(F.length("word") >= DEPTH).select("word")
    place = F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("place")
    rest = long_.select("word", place).select("word", "place", _without(F.col("word"), F.col("place")).alias("rest"))
    replaced = rest.join(rest.withColumnRenamed("word", "other"), ["place", "rest"]).where("word > other")
    deleted = rest.join(long_.withColumnRenamed("word", "other"), F.col("rest") == F.col("other"))
    pairs = replaced.select("word", "other").unionByName(deleted.select("word", "other")).distinct()
    return pairs.where((F.length("word") > DEPTH) | (F.length("other") > DEPTH))


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of words(word, n)."""
    pairs = neighbours(words)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    near = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other"))).alias("best"))
    is_form = -F.col("best.minus") >= factor * F.col("n")
    out = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"),
    ))
    discard(pairs)
    # A form has `factor` times the occurrences, so chains end; every step doubles what has been followed.
    roots = written(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = roots.join(roots.toDF("root", "next"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = written(further)
        discard(roots)
        roots = after.select("word", "root")
        if after.where("moved").isEmpty():
            break
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(written(counted_words(documents(spark, sf_dir))))
