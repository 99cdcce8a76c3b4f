"""Line dedup by a log-template tree, with DataFrame functions only.

A line's path in the tree has a fixed depth: its number of tokens, then its `LEADING` first tokens; tokens with a digit
are variable from the start (`<*>`). At a leaf, a token is constant at its place if `MIN_TEXTS` distinct lines' texts have
it there; other places are variable. A line joins the leaf's generalised template if at least `SIMILARITY` of its tokens
are constant, else it is a template of its own. A template recurs if it stands in at least `MIN_TEXTS` distinct texts.
Lines of recurring templates are dropped where the texts are of at least `MIN_TEXTS` groups of near copies; lines of fewer
than `MIN_TOKENS` tokens are never dropped.

A text's group is named by one of its lines: if more than `OWN` of its tokens are its own, by the least hash of those
lines; else, as a copy whose words recur with it, by the least of its recurring templates. Tokens are a text's own if they
stand in a line that doesn't recur. Where these are less than half of the text, such lines may also be the edited ones of a
copy: then the share of a line's `WIDTH`-word shingles that stand in recurring lines of any text is taken off (`SHINGLES`
of them are looked up, evenly spaced). Two texts with more than a ninth of their own share less than 0.8 of their words, so
they aren't near copies, and however much of them is boilerplate, it goes; copies, edited or not, share few names however
many they are.

The text is read four times and shuffled at most in the last two: once for each line's hash and leaf, which need the
line's length and its first tokens only; once for the lines of leaves with enough texts, the only ones that are masked and
taken apart; once for the own lines of texts that may be edited copies; once to leave lines out. What is dropped depends on the text alone, so texts are known by their hash, and equal
texts are worked on once after the first pass. Counts are of distinct hashes and are combined before the shuffle, so one
very common line or text is no hot key. Small results are broadcast up to `BROADCAST_ROWS` or `BROADCAST_KEYS`, larger ones are
joined.

Null text has no lines and stays null. Empty text has one line without tokens. Rows are judged by their text, so null or
repeated doc_ids are no special case and tied rows fare alike; repeated rows and copies count as one text. Very long texts
and lines are taken whole. An empty table gives an empty result. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, packed, unpacked, written

MIN_TEXTS, MIN_TOKENS, LEADING, SIMILARITY = 10, 4, 2, 0.6
OWN, WIDTH, SHINGLES = 1 / 9, 5, 8
VARIABLE = "<*>"
BROADCAST_ROWS, BROADCAST_KEYS = 200_000, 500_000  # of a few longs each; of one long, or of one and some places


def tight(line: Column) -> Column:
    """A line's tokens joined by single blanks. ASCII white space only; most lines are in this form already."""
    loose = F.contains(line, F.lit("  ")) | line.startswith(" ") | line.endswith(" ")
    for c in "\t\r\x0b\x0c":
        loose = loose | F.contains(line, F.lit(c))
    return F.when(loose, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def masked(tokens: Column) -> Column:
    """Tokens joined by blanks, those with a digit as variables."""
    return F.when(tokens.rlike("[0-9]"), F.regexp_replace(tokens, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", VARIABLE)).otherwise(tokens)


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _lines(texts: DataFrame) -> DataFrame:
    """text_key, at, raw_key (the hash of the tokens), tokens, leaf, tight of every line with tokens of texts(text)."""
    every = texts.where("text is not null").select(text_hash(F.col("text")).alias("text_key"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    words = every.select("text_key", "at", tight(F.col("line")).alias("tight")).where("tight != ''")
    blanks = F.octet_length("tight") - F.octet_length(F.replace("tight", F.lit(" "), F.lit("")))
    return words.select(
        "text_key", "at", F.xxhash64("tight").alias("raw_key"), (blanks + 1).cast("int").alias("tokens"),
        F.xxhash64(blanks, masked(F.substring_index("tight", " ", LEADING))).alias("leaf"), "tight",
    )


def _hinted(table: DataFrame) -> DataFrame:
    """table, to be broadcast if it is small; else the optimiser chooses."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _shingles(tight: Column, most: int | None = None) -> Column:
    """The hashes of a line's shingles, of all or of so many evenly spaced ones; of the whole of a shorter line."""

    def made(words: Column) -> Column:
        n = F.greatest(F.size(words) - (WIDTH - 1), F.lit(1))
        k = n if most is None else F.least(n, F.lit(most))
        return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.xxhash64(F.array_join(F.slice(words, F.floor(i * n / k).cast("int") + 1, WIDTH), " ")))

    return F.array_distinct(F.get(F.transform(F.array(F.split(tight, " ")), made), F.lit(0)))


def _own_tokens(keys: DataFrame, texts: DataFrame, common: DataFrame, near: DataFrame, mixed: DataFrame) -> DataFrame:
    """text_key, own (tokens), own_key of the texts of mixed(text_key), once words of their lines that recur elsewhere are taken off."""
    wanted = F.broadcast(mixed) if mixed.count() <= BROADCAST_KEYS else mixed
    some = texts.withColumn("text_key", text_hash(F.col("text"))).join(wanted, "text_key", "left_semi")
    lines = _lines(some.select("text")).join(_hinted(common.select("raw_key")), "raw_key", "left_anti").groupBy("raw_key").agg(F.first("tight").alias("tight"))
    sketch = lines.select("raw_key", F.explode(_shingles(F.col("tight"), SHINGLES)).alias("shingle"))
    recurs = written(near.join(_hinted(common.select("raw_key")), "raw_key", "left_semi").select(F.explode(_shingles(F.col("tight"))).alias("shingle")).distinct())
    share = sketch.join(_hinted(recurs.withColumn("known", F.lit(1.0))), "shingle", "left").groupBy("raw_key").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("known"))
    share = written(share.where("known > 0"))
    own = keys.join(wanted, "text_key", "left_semi").join(_hinted(common.select("raw_key")), "raw_key", "left_anti").join(_hinted(share), "raw_key", "left")
    known = F.coalesce("known", F.lit(0.0))
    out = written(own.groupBy("text_key").agg(F.sum(F.col("tokens") * (1 - known)).alias("own"), F.min(F.when(known < 0.5, F.col("raw_key"))).alias("own_key")))
    discard(recurs, share)
    return out


def recurring_lines(keys: DataFrame, texts: DataFrame, min_texts: int = MIN_TEXTS, similarity: float = SIMILARITY) -> DataFrame:
    """raw_key of the lines of recurring templates, of keys(text_key, raw_key, tokens, leaf) and the texts they are from."""
    leaves = keys.groupBy("leaf").agg(F.count_distinct("text_key").alias("texts"))
    full = written(leaves.where(F.col("texts") >= min_texts).select("leaf"))
    few = _hinted(full)
    near = written(_lines(texts).join(few, "leaf").groupBy("leaf", "raw_key").agg(F.first("tight").alias("tight")))
    forms = written(near.withColumn("masked", masked(F.col("tight"))).select("leaf", "raw_key", F.xxhash64("masked").alias("line_key"), "masked"))
    often = keys.join(few, "leaf").select("text_key", "raw_key").distinct().join(_hinted(forms.select("raw_key", "line_key")), "raw_key").select("text_key", "line_key").distinct()
    often = written(often)
    counts = often.groupBy("line_key").agg(F.count(F.lit(1)).alias("texts"))
    distinct = written(forms.groupBy("leaf", "line_key").agg(F.first("masked").alias("masked")).join(counts, "line_key"))
    places = distinct.select("leaf", "line_key", "texts", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    places = places.select("leaf", "line_key", "texts", F.xxhash64("place", "token").alias("spot"), F.xxhash64("place").alias("open"), (F.col("token") == VARIABLE).alias("variable"))
    constant = written(places.where("not variable").groupBy("leaf", "spot").agg(F.sum("texts").alias("n")).where(F.col("n") >= min_texts).select("leaf", "spot", F.lit(True).alias("fixed")))
    marked = places.join(_hinted(constant), ["leaf", "spot"], "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
    general = marked.groupBy("leaf", "line_key").agg(F.bit_xor(F.when(F.col("fixed"), F.col("spot")).otherwise(F.col("open"))).alias("general"), F.avg(F.col("fixed").cast("double")).alias("share"))
    template = written(general.select("line_key", F.when(F.col("share") >= similarity, F.xxhash64("leaf", "general")).otherwise(F.col("line_key")).alias("template")))
    recurs = often.join(_hinted(template), "line_key").groupBy("template").agg(F.count_distinct("text_key").alias("n")).where(F.col("n") >= min_texts)
    common = written(forms.select("raw_key", "line_key").join(template, "line_key").join(recurs.select("template"), "template").select("raw_key", "template"))
    discard(often, distinct, constant, template, forms, full)
    in_line = F.col("template").isNull()
    of_text = keys.join(_hinted(common), "raw_key", "left").groupBy("text_key").agg(
        F.sum("tokens").alias("tokens"), F.sum(F.when(in_line, F.col("tokens")).otherwise(0)).alias("apart"),
        F.min(F.when(in_line, F.col("raw_key"))).alias("line_key"), F.min("template").alias("common_key"), F.collect_set("template").alias("templates"),
    )
    of_text = written(of_text.where("common_key is not null"))
    own = _own_tokens(keys, texts, common, near, of_text.where((F.col("apart") > OWN * F.col("tokens")) & (2 * F.col("apart") < F.col("tokens"))).select("text_key"))
    # A text of which more than OWN is its own, but no line for the larger part, is named by itself.
    group = F.when(2 * F.col("apart") >= F.col("tokens"), F.col("line_key")).when(F.col("own") > OWN * F.col("tokens"), F.coalesce("own_key", "text_key")).otherwise(F.col("common_key"))
    groups = of_text.join(own, "text_key", "left").select(group.alias("group"), F.explode("templates").alias("template")).groupBy("template").agg(F.count_distinct("group").alias("n"))
    drop = written(common.join(groups.where(F.col("n") >= min_texts), "template").select("raw_key").distinct())
    discard(common, near, of_text, own)
    return drop


def strip_templates(docs: DataFrame, min_texts: int = MIN_TEXTS, similarity: float = SIMILARITY) -> DataFrame:
    """A struct `doc` of docs' columns, text without recurring lines, n_lines, n_dropped."""
    texts = docs.select("text")
    keys = written(_lines(texts).select("text_key", "at", "raw_key", "tokens", "leaf"))  # no text
    drop = recurring_lines(keys, texts, min_texts, similarity)
    gone = keys.where(F.col("tokens") >= MIN_TOKENS).join(_hinted(drop), "raw_key").groupBy("text_key").agg(F.collect_set("at").alias("gone"))
    gone = written(gone)
    discard(keys, drop)
    lines, places = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    every = F.split("text", "\n")
    left = F.array_join(F.filter(every, lambda x, i: ~F.array_contains("gone", i)), "\n")
    rows = docs.select(packed(docs.columns).alias("doc"), F.col("text").alias("text"), text_hash(F.col("text")).alias("text_key"))
    return rows.join(F.broadcast(gone) if lines + places <= BROADCAST_KEYS else gone, "text_key", "left").select(
        "doc",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(every)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def dedup(docs: DataFrame, **limits) -> DataFrame:
    """docs without lines of recurring templates; a document of which no word is left goes. n_chars follows."""
    out = strip_templates(docs, **limits)
    columns = {c: unpacked(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*(x.alias(c) for c, x in columns.items()))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip_templates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
