"""Class schemas as a table; validation with types, and repairs that are taken only if errors fall.

The table has a row for each class and attribute: a few thousand, at most `MOST`. It goes into the plan as one constant, and an
event is checked within its row, without a join and without being taken apart. Events are maps of dotted path to text, so an attribute is
there if a path begins with its name, and a type is what the text can be read as.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce
from .preparse import as_map, entry
from .staging import fenced

MOST = 100_000
TABLE = "class_uid int, class_name string, name string, type string, requirement string"
# Attributes that any class may have.
BASE = [
    "class_uid", "class_name", "category_uid", "category_name", "activity_id", "activity_name", "type_uid", "type_name", "time", "severity_id", "severity", "status_id", "status",
    "message", "metadata", "observables", "unmapped", "raw_data", "start_time", "end_time", "timezone_offset", "count",
]


def read_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """The table of a folder of class_*.json files: class_uid, class_name and attributes (name to type and requirement)."""
    attributes = "map<string,struct<type:string,requirement:string>>"
    files = spark.read.schema(f"class_uid int, class_name string, attributes {attributes}").option("multiLine", True).option("pathGlobFilter", "class_*.json").json(folder)
    rows = files.where("class_uid IS NOT NULL").select("class_uid", "class_name", F.explode_outer("attributes").alias("name", "spec"))
    return rows.select("class_uid", "class_name", "name", F.coalesce("spec.type", F.lit("string")).alias("type"), F.coalesce("spec.requirement", F.lit("optional")).alias("requirement"))


def fits(value: Column, kind: Column) -> Column:
    """Whether a text can be read as a type; unknown types and strings take all."""
    whole, number = value.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(value).try_cast("double").isNotNull()
    return F.when(value.isNull(), True).when(kind.isin("integer", "long"), whole).when(kind == "float", number).when(kind == "boolean", F.lower(value).isin("true", "false")).when(kind == "object", value.startswith("{")).when(kind == "array", value.startswith("[")).otherwise(True)


def repaired(value: Column, kind: Column) -> Column:
    """A value of the type that the text speaks for, as text; null if there is none."""
    return F.when(kind.isin("integer", "long"), coerce.integer(value).cast("string")).when(kind == "float", coerce.floating(value).cast("string")).when(kind == "boolean", coerce.boolean(value).cast("string"))


def _problem(name: Column, kind: str, message: Column) -> Column:
    return F.struct(name.alias("field"), F.lit(kind).alias("error_type"), message.alias("message"))


def _checked(event: Column, class_uid: Column, spec: Column, strict: bool) -> tuple[Column, Column, Column]:
    """(errors, warnings, coverage) of an event against its class's attributes; spec is null where the class is unknown."""
    tops = F.array_distinct(F.transform(F.map_keys(event), lambda k: F.substring_index(k, ".", 1)))
    none = F.array().cast("array<struct<field:string,error_type:string,message:string>>")
    missing = F.transform(F.filter(spec, lambda a: (a["requirement"] == "required") & ~F.array_contains(tops, a["name"])), lambda a: _problem(a["name"], "missing_required", F.format_string("Required field '%s' is missing", a["name"])))
    typed = F.filter(spec, lambda a: F.map_contains_key(event, a["name"]) & ~a["name"].isin(BASE))
    wrong = F.transform(F.filter(typed, lambda a: ~fits(F.element_at(event, a["name"]), a["type"])), lambda a: _problem(a["name"], "wrong_type", F.format_string("Field '%s' expected %s", a["name"], a["type"])))
    unknown = F.filter(tops, lambda t: ~t.isin(BASE) & ~F.exists(spec, lambda a: a["name"] == t))
    unknown = F.transform(unknown, lambda t: _problem(t, "unknown_field", F.format_string("Field '%s' not in schema for class %d", t, class_uid)))
    given, category = F.element_at(event, "class_uid"), F.element_at(event, "category_uid").try_cast("int")
    other = F.when(given.isNotNull() & (F.coalesce(given.try_cast("int"), F.lit(-1)) != class_uid), F.array(_problem(F.lit("class_uid"), "invalid_value", F.format_string("Event class_uid (%s) doesn't match expected (%d)", given, class_uid))))
    side = F.when(category.isNotNull() & (category != F.floor(class_uid / 1000)), F.array(_problem(F.lit("category_uid"), "invalid_value", F.format_string("category_uid (%d) inconsistent with class_uid (%d)", category, class_uid))))
    lost = F.when(spec.isNull(), F.array(_problem(F.lit("class_uid"), "unknown_field", F.format_string("No schema found for class_uid %d", class_uid))))
    or_none = lambda x: F.coalesce(x, none)
    errors = F.concat(or_none(other), or_none(missing), or_none(wrong), *([or_none(unknown)] if strict else []))
    warnings = F.concat(or_none(side), or_none(lost), *([] if strict else [or_none(unknown)]))
    there = F.size(F.filter(spec, lambda a: F.array_contains(tops, a["name"])))
    return errors, warnings, F.when(spec.isNull(), 0.0).when(F.size(spec) == 0, 1.0).otherwise(there / F.size(spec))


def validate(events: DataFrame, schemas: DataFrame, strict: bool = False, fix: bool = False) -> DataFrame:
    """events(class_uid, event, …) with errors, warnings, valid, coverage; with fix also `fixed`, and event as repaired where errors fall.

    Repairs: class_uid and category_uid that are required and missing; values whose type doesn't fit but that speak for one
    of it. A null class_uid is an error of its own. Attributes without a name don't count.
    """
    rows = schemas.orderBy("class_uid", "name").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} attributes of classes")
    classes: dict[int, list[dict]] = {}
    for r in rows:
        own = classes.setdefault(r["class_uid"], [])
        if r["name"] is not None:
            own.append({k: r[k] for k in ("name", "type", "requirement")})
    table = F.from_json(F.lit(json.dumps(classes)), "map<string,array<struct<name:string,type:string,requirement:string>>>")
    out = fenced(events, __spec=F.element_at(table, F.col("class_uid").cast("string")))
    uid = F.coalesce(F.col("class_uid"), F.lit(0))
    absent = F.array(_problem(F.lit("class_uid"), "missing_required", F.lit("No class_uid in event and none provided")))

    def judged(df: DataFrame, event: str, prefix: str) -> DataFrame:
        errors, warnings, coverage = _checked(F.col(event), uid, F.col("__spec"), strict)
        return fenced(df, **{f"{prefix}errors": F.when(F.col("class_uid").isNull(), absent).otherwise(errors), f"{prefix}warnings": warnings, f"{prefix}coverage": coverage})

    out = judged(out, "event", "")
    if fix:
        own = F.filter(F.col("errors"), lambda e: e["error_type"] == "missing_required")
        meta = F.transform(F.filter(own, lambda e: e["field"].isin("class_uid", "category_uid")), lambda e: entry(e["field"], F.when(e["field"] == "class_uid", uid).otherwise(F.floor(uid / 1000)).cast("string")))
        bad = F.filter(F.col("errors"), lambda e: e["error_type"] == "wrong_type")
        kind = lambda name: F.get(F.filter(F.col("__spec"), lambda a: a["name"] == name), F.lit(0))["type"]
        typed = F.filter(F.transform(bad, lambda e: entry(e["field"], repaired(F.element_at(F.col("event"), e["field"]), kind(e["field"])))), lambda e: e["value"].isNotNull())
        out = judged(fenced(out, __fixed=as_map(F.concat(F.map_entries("event"), meta, typed))), "__fixed", "__")
        better = F.coalesce(F.size("__errors") < F.size("errors"), F.lit(False))
        out = out.withColumn("fixed", better).withColumns({"event": F.when(F.col("fixed"), F.col("__fixed")).otherwise(F.col("event"))} | {c: F.when(F.col("fixed"), F.col(f"__{c}")).otherwise(F.col(c)) for c in ("errors", "warnings", "coverage")})
        out = out.drop("__fixed", "__errors", "__warnings", "__coverage")
    return out.withColumn("valid", F.size("errors") == 0).drop("__spec")
