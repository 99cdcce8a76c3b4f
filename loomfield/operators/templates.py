"""Line templates: a tree by number of tokens and first token, clusters at its leaves, slots typed by majority, extraction by slot.

Lines are first reduced to forms (tokens with a digit as `<*>`), which Spark counts; a digit token that is the same in all
lines of a form is put back. Only forms are clustered: leaf by leaf, in the order in which they first came, each joining the
most similar template (share of equal tokens, `similarity` at least; of equals the one with fewest slots, then the oldest) or
beginning one; places that differ become slots. So what is learned does not depend on how the lines were split over tasks,
a very common line costs one row, and the fold holds one leaf's templates.

A slot's type is that of most of its values; of equally many the type that came first. Its path is told by the type and the
last fixed token before it, else by the type alone. Lines without tokens are left out; null lines too. Order: any number
that tells which line came first; lines of one number go by their form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..sources.shared import saved
from .normalize import ALIASES
from .preparse import as_map, entry
from .rules import best_rows

SLOT, SIMILARITY, LEAST, SAMPLES, BROADCAST_LEAVES = "<*>", 0.4, 2, 5, 20_000

# Path of a slot by its type and the fixed token before it; and by its type alone.
CONTEXT = {
    "src_endpoint.ip": [("ip", t) for t in ("from", "src", "SRC", "source", "client")], "dst_endpoint.ip": [("ip", t) for t in ("to", "dst", "DST", "dest", "destination", "server", "->")],
    "src_endpoint.port": [("port", "port"), ("port", "SPT")], "dst_endpoint.port": [("port", "DPT")], "user": [("user", "for"), ("user", "user"), ("user", "User"), ("email", "")],
    "actor.user.name": [("user", "by")], "device.hostname": [("hostname", "")], "process.name": [("process_ref", "")], "time": [("timestamp", "")], "process.file.path": [("path", "")],
}
BY_TYPE = {
    "ip": "src_endpoint.ip", "port": "src_endpoint.port", "user": "user", "hostname": "device.hostname", "timestamp": "time", "process_ref": "process.name", "path": "process.file.path",
    "email": "user", "integer": "metadata.count",
}
TOWARDS = ["->", "dst", "DST", "dest", "destination", "server"]  # tokens before an address with a port that make it the target


def tokens_of(raw: Column) -> Column:
    return F.filter(F.split(raw, r"\s+"), lambda t: t != "")


def _head(tokens: Column) -> Column:
    first = F.get(tokens, F.lit(0))
    return F.when(first.rlike("[0-9]"), SLOT).otherwise(first)


def _clustered(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Forms (form, key, n_tokens, head, tokens), leaf by leaf in order, to (key, cluster, template) once a leaf has ended."""
    leaf, templates, members = None, [], []

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in members], pa.int64()), "cluster": pa.array([templates[c][0] for _, c in members], pa.int64()), "template": pa.array([templates[c][1] for _, c in members], pa.list_(pa.string()))})

    for batch in batches:
        for key, n, head, tokens in zip(*(batch.column(c).to_pylist() for c in ("key", "n_tokens", "head", "tokens")), strict=True):
            if (n, head) != leaf:
                if members:
                    yield emit()
                leaf, templates, members = (n, head), [], []
            best = None
            for c, (_, own) in enumerate(templates):
                same = sum(a == b != SLOT for a, b in zip(own, tokens, strict=True))
                rank = (same / n, own.count(SLOT) * -1, -c)
                if same >= similarity * n and (best is None or rank > best[0]):
                    best = (rank, c)
            if best is None:
                templates.append((key, list(tokens)))
                members.append((key, len(templates) - 1))
            else:
                own = templates[best[1]][1]
                own[:] = [a if a == b else SLOT for a, b in zip(own, tokens, strict=True)]
                members.append((key, best[1]))
    if members:
        yield emit()


def mine(logs: DataFrame, order: str, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """n_tokens, head, cluster, template, cluster_size, slots (position, entity, path, before, samples) of clusters of at least `least` lines of logs(raw_log)."""
    lines = logs.where("raw_log is not null").select(F.col(order).cast("long").alias("ord"), tokens_of(F.col("raw_log")).alias("tokens")).where(F.size("tokens") > 0)
    form = F.transform("tokens", lambda t: F.when(t.rlike("[0-9]"), SLOT).otherwise(t))
    lines = lines.withColumn("key", F.xxhash64(F.array_join(form, " ")))
    forms = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.first(form).alias("form"))
    spots = lines.select("key", "ord", F.posexplode("tokens").alias("at", "token")).where(F.col("token").rlike("[0-9]"))
    spots = saved(spots.groupBy("key", "at", coerce.entity(F.col("token")).alias("entity")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.min("token").alias("low"), F.max("token").alias("high")))
    fixed = spots.groupBy("key", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("at", "low"))).alias("fixed"))
    whole = F.transform("form", lambda t, i: F.coalesce(F.element_at("fixed", i), t))
    forms = saved(forms.join(fixed, "key", "left").select("key", "n", "first", F.when(F.col("fixed").isNull(), F.col("form")).otherwise(whole).alias("tokens"), F.size("form").alias("n_tokens"), _head(F.col("form")).alias("head")))
    dealt = forms.select("key", "n_tokens", "head", "tokens", "first").repartition("n_tokens", "head").sortWithinPartitions("n_tokens", "head", "first", "key")
    placed = saved(dealt.mapInArrow(lambda batches: _clustered(batches, similarity), "key long, cluster long, template array<string>"))
    members = forms.join(placed, "key")
    clusters = members.groupBy("cluster").agg(F.sum("n").alias("cluster_size"), F.first("template").alias("template"), F.first("n_tokens").alias("n_tokens"), F.first("head").alias("head"), F.min("first").alias("first")).where(F.col("cluster_size") >= least)
    of_words = members.select("cluster", "n", "first", F.posexplode(F.zip_with("tokens", "template", lambda t, p: F.when((p == SLOT) & (t != SLOT), t))).alias("at", "token")).where("token is not null")
    of_words = of_words.where(~F.col("token").rlike("[0-9]")).select("cluster", "at", coerce.entity(F.col("token")).alias("entity"), "n", "first")
    of_numbers = spots.join(placed, "key").where(F.get("template", F.col("at")) == SLOT).select("cluster", "at", "entity", "n", "first")
    votes = of_words.unionByName(of_numbers).groupBy("cluster", "at", "entity").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    typed = best_rows(votes, ["cluster", "at"], [F.desc("n"), F.asc("first"), F.asc("entity")]).select("cluster", "at", "entity")
    heads = best_rows(lines.join(placed.select("key", "cluster"), "key"), ["cluster"], [F.asc("ord"), F.asc("key")], SAMPLES)
    heads = heads.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "tokens"))), lambda x: x["tokens"]).alias("lines"))  # SAMPLES rows each
    before = F.element_at(F.concat(F.array(F.lit("")), F.filter(F.slice("template", F.lit(1), F.col("at")), lambda t: t != SLOT)), -1)
    slots = typed.join(clusters.select("cluster", "template"), "cluster").join(heads, "cluster").withColumn("before", F.rtrim(before, F.lit(":")))
    by_context = F.create_map(*(F.lit(x) for path, pairs in CONTEXT.items() for kind, token in pairs for x in (f"{kind} {token}", path)))
    by_type = F.create_map(*(F.lit(x) for pair in BY_TYPE.items() for x in pair))
    path = F.when(F.col("entity").isin("kv_token", "ip_port"), F.lit(None)).otherwise(F.coalesce(F.element_at(by_context, F.concat_ws(" ", "entity", "before")), F.element_at(by_type, F.col("entity"))))
    slot = F.struct(F.col("at").alias("position"), "entity", path.alias("path"), "before", F.transform("lines", lambda x: F.get(x, F.col("at"))).alias("samples"))
    slots = slots.groupBy("cluster").agg(F.sort_array(F.collect_list(slot)).alias("slots"))
    none = F.array().cast(slots.schema["slots"].dataType)
    return clusters.join(slots, "cluster", "left").select("n_tokens", "head", "cluster", F.array_join("template", " ").alias("template"), "cluster_size", F.coalesce("slots", none).alias("slots"), "first")


def extract(logs: DataFrame, templates: DataFrame) -> DataFrame:
    """logs(raw_log, …) with template_cluster and template_fields (path to text) of the template all of whose fixed tokens the line has.

    A leaf's templates come as one row, fewest slots first, so no line is multiplied or shuffled where they can be broadcast.
    """
    fewest = F.struct(F.size("slots").alias("n_slots"), "first", "cluster", F.split("template", " ").alias("fixed"), "slots")
    leaves = templates.groupBy("n_tokens", "head").agg(F.sort_array(F.collect_list(fewest)).alias("__templates"))
    leaves = saved(leaves)
    out = logs.withColumn("__tokens", tokens_of(F.col("raw_log"))).withColumns({"n_tokens": F.size("__tokens"), "head": _head(F.col("__tokens"))})
    out = out.join(F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves, ["n_tokens", "head"], "left")
    fits = lambda x: F.forall(F.zip_with(x["fixed"], F.col("__tokens"), lambda p, t: (p == SLOT) | (p == t)), lambda y: y)
    out = out.withColumn("__template", F.get(F.filter("__templates", fits), F.lit(0)))
    aliases = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))

    def taken(slot: Column) -> Column:
        value = F.get(F.col("__tokens"), slot["position"])
        side = F.when(slot["before"].isin(TOWARDS), "dst_endpoint").otherwise("src_endpoint")
        name, text = F.regexp_extract(value, r'^(\w+)="?([^"]*)"?$', 1), F.regexp_extract(value, r'^(\w+)="?([^"]*)"?$', 2)
        ip, port = F.regexp_extract(value, r"^(.+):(\d+)$", 1), F.regexp_extract(value, r"^(.+):(\d+)$", 2)
        alone = entry(slot["path"], F.when(slot["entity"] == "process_ref", F.regexp_extract(value, r"^(\w+)\[", 1)).otherwise(value))
        return F.when(slot["entity"] == "ip_port", F.array(entry(F.concat(side, F.lit(".ip")), ip), entry(F.concat(side, F.lit(".port")), port))).when(slot["entity"] == "kv_token", F.array(entry(F.element_at(aliases, name), text))).otherwise(F.array(alone))

    fields = F.filter(F.flatten(F.transform(F.col("__template.slots"), taken)), lambda e: e["key"].isNotNull() & (e["value"] != ""))
    out = out.withColumns({"template_cluster": F.col("__template.cluster"), "template_fields": as_map(fields)})
    return out.drop("__tokens", "n_tokens", "head", "__templates", "__template")
