"""The pattern library: rules that tell a line's class and take its fields, kept as rows.

Of a library's patterns for a line's format, the most specific one that fits is chosen by one native decision, each regular
expression being compiled once a task. What the chosen pattern takes (expression, paths, fixed values, severity rules) comes
by a broadcast join of the library's table, so the projection doesn't grow with the number of fields. Libraries of many JSON
key sets can be tested by `json_key_patterns`, a relational division, instead.
"""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .preparse import SEP, entry

ENTRIES = "array<struct<key:string,value:string>>"
RULES = "array<struct<field:string,low:double,high:double,value:string,severity:string>>"
ROW = f"pattern:string,class_uid:int,class_name:string,search:string,parts:string,paths:array<string>,names:array<string>,name_paths:array<string>,fixed:{ENTRIES},severities:{RULES}"
# Words that alone, as the substring of a pattern without other tests, would fit nearly any line.
GENERIC = {"system", "config", "error", "warning", "info", "debug", "analytics", "traps", "endpoint"}


@dataclass(frozen=True)
class Pattern:
    """A rule for lines of some formats. groups: paths of the regex's groups in order (empty: not taken); field_map: parsed
    field to path; severity: (field, low, high, value, severity id), the first that holds."""

    name: str
    formats: tuple[str, ...]
    class_uid: int
    regex: str = ""
    contains: str = ""
    json_has: tuple[str, ...] = ()
    json_match: dict[str, str] = field(default_factory=dict)
    static: dict[str, str] = field(default_factory=dict)
    groups: tuple[str, ...] = ()
    field_map: dict[str, str] = field(default_factory=dict)
    severity: tuple[tuple[str, float | None, float | None, str | None, int], ...] = ()
    class_name: str | None = None

    @property
    def specificity(self) -> int:
        groups = len(self.groups)
        return 3 * bool(self.json_match) + 2 * bool(self.json_has) + bool(self.contains) + (len(self.regex) > 30) + (2 if groups >= 5 else 1 if groups >= 3 else 0)

    def admitted(self) -> bool:
        """Short expressions, and generic words without another test, match too much."""
        if self.regex and len(self.regex) < 15 and not (self.contains or self.json_has):
            return "catchall" in self.name or "universal" in self.name
        return bool(self.regex or self.json_has or self.json_match) or (bool(self.contains) and self.contains.lower() not in GENERIC)

    def matches(self, raw: Column, fields: Column) -> Column:
        """Substring, then JSON keys, then expression; a substring alone never decides."""
        by_json, out = bool(self.json_has or self.json_match), F.lit(True)
        if self.contains:
            out = out & F.contains(raw, F.lit(self.contains))
        for key in self.json_has:
            out = out & F.map_contains_key(fields, key)
        for key, value in self.json_match.items():
            out = out & (F.coalesce(F.element_at(fields, key), F.lit("")) == value)
        return out if by_json else out & raw.rlike(self.regex) if self.regex else F.lit(False)


class Library:
    """Admitted patterns, most specific first; load order breaks ties."""

    def __init__(self, patterns: list[Pattern]):
        self.patterns = sorted((p for p in patterns if p.admitted()), key=lambda p: -p.specificity)

    def choose(self, raw: Column, log_format: Column, fields: Column, formats: Iterable[str] | None = None) -> Column:
        """The number of the first pattern that fits, by the line's format; formats: those that occur, where they are known."""
        out = None
        for fmt in sorted({f for p in self.patterns for f in p.formats if formats is None or f in formats}):
            own = None
            for k, p in enumerate(self.patterns):
                if fmt in p.formats:
                    test = F.coalesce(p.matches(raw, fields), F.lit(False))
                    own = F.when(test, k) if own is None else own.when(test, k)
            out = F.when(log_format == fmt, own) if out is None else out.when(log_format == fmt, own)
        return F.lit(None).cast("int") if out is None else out

    def row(self, number: Column) -> Column:
        """What the pattern of a number takes from a line, of a constant array: there is nothing to join or to shuffle."""
        rows = []
        for p in self.patterns:
            regex = p.regex if p.groups and not (p.json_has or p.json_match) else None
            rows.append({
                "pattern": p.name, "class_uid": p.class_uid, "class_name": p.class_name, "search": f"(?s)^.*?(?:{regex}).*$" if regex else None, "parts": SEP.join(f"${i + 1}" for i in range(len(p.groups))) if regex else None,
                "paths": p.groups, "names": list(p.field_map), "name_paths": list(p.field_map.values()), "fixed": [{"key": k, "value": v} for k, v in p.static.items()],
                "severities": [dict(zip(("field", "low", "high", "value", "severity"), (f, lo, hi, v, str(s)), strict=True)) for f, lo, hi, v, s in p.severity],
            })
        return F.get(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ROW}>>"), number)


def extracted(raw: Column, fields: Column, row: Column) -> Column:
    """(path, value) entries that a pattern's row takes from a line; later ones win: fixed values, severity by rule, parsed
    fields, groups."""
    none = F.array().cast(ENTRIES)
    values = F.split(F.regexp_replace(raw, row["search"], row["parts"]), SEP)
    by_group = F.when(row["search"].isNotNull(), F.filter(F.zip_with(row["paths"], values, entry), lambda e: (e["key"] != "") & (e["value"] != "")))
    # A dotted name also reaches into objects that are too large to be flattened.
    inside = lambda n: F.when(F.contains(n, F.lit(".")) & F.ltrim(raw).startswith("{"), F.call_function("get_json_object", raw, F.concat(F.lit("$."), n)))
    by_name = F.filter(F.zip_with(row["names"], row["name_paths"], lambda n, p: entry(p, F.coalesce(F.element_at(fields, n), inside(n)))), lambda e: e["value"].isNotNull())
    everything = F.concat(F.coalesce(by_name, none), F.coalesce(by_group, none))
    source = lambda r: F.coalesce(F.element_at(fields, r["field"]), F.get(F.filter(everything, lambda e: e["key"] == r["field"]), F.lit(0))["value"])
    holds = F.filter(row["severities"], lambda r: F.when(r["value"].isNotNull(), source(r) == r["value"]).otherwise(source(r).try_cast("bigint").between(r["low"], r["high"])))
    by_rule = F.transform(F.slice(holds, 1, 1), lambda r: entry(F.lit("severity_id"), r["severity"]))
    return F.concat(F.coalesce(row["fixed"], none), F.when(F.size(row["severities"]) > 0, by_rule).otherwise(none), everything)


def java_regex(regex: str) -> tuple[str, list[str]]:
    """A named-group expression with plain groups, and the groups' names in order ("" where it had none)."""
    compiled = re.compile(regex)
    names = {number: name for name, number in compiled.groupindex.items()}
    return re.sub(r"\(\?P<\w+>", "(", re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{compiled.groupindex[m[1]]}", regex)), [names.get(k + 1, "") for k in range(compiled.groups)]


def pattern_of(row: dict) -> Pattern | None:
    """A pattern from a mapping with match, ocsf_class_uid, static, field_map and severity_map; None if it can't be used."""
    match, wanted = row.get("match") or {}, {str(k): str(v) for k, v in (row.get("field_map") or {}).items()}
    try:
        regex, names = java_regex(str(match.get("regex") or ""))
        formats = match.get("log_format") or []
        has = match.get("json_has") or []
        rules = row.get("severity_map") or {}
        bounds = [(str(wanted.get(rules.get("field"), rules.get("field"))), *map(float, r.get("range") or (0, -1)), str(r["value"]) if "value" in r else None, int(r["severity_id"])) for r in rules.get("rules") or ()]
        return Pattern(
            str(row["name"]), tuple([formats] if isinstance(formats, str) else map(str, formats)), int(row.get("ocsf_class_uid") or 0), regex, str(match.get("contains") or ""), tuple([has] if isinstance(has, str) else map(str, has)),
            {str(k): str(v) for k, v in (match.get("json_match") or {}).items()}, {str(k): str(v) for k, v in (row.get("static") or {}).items()}, tuple(wanted.get(n, "") for n in names),
            {k: v for k, v in wanted.items() if k not in names}, tuple(bounds), row.get("ocsf_class_name"),
        )
    except (KeyError, TypeError, ValueError, re.error):
        return None


def read_library(path: str, spark: SparkSession | None = None) -> Library:
    """The library of a folder of YAML files: those at the top in order of name, then those of each subfolder. Files and patterns
    that can't be read, and expressions that Java doesn't know, are left out."""
    import yaml

    top = sorted(glob.glob(f"{path}/*.y*ml"))
    rest = [f for d in sorted(x.path for x in os.scandir(path) if x.is_dir()) for f in sorted(glob.glob(f"{d}/*.y*ml"))]
    out = []
    for name in top + rest:
        try:
            with open(name, encoding="utf-8") as f:
                rows = (yaml.safe_load(f) or {}).get("patterns") or []
        except (yaml.YAMLError, AttributeError, UnicodeDecodeError):
            continue
        out += [p for row in rows if isinstance(row, dict) and (p := pattern_of(row)) is not None]
    if spark is not None:
        java = spark.sparkContext._jvm.java.util.regex.Pattern
        out = [p for p in out if not p.regex or _compiles(java, p.regex)]
    return Library(out)


def _compiles(java, regex: str) -> bool:
    from py4j.protocol import Py4JJavaError

    try:
        java.compile(regex)
        return True
    except Py4JJavaError:
        return False


_SSH = {"activity_id": "1", "auth_protocol": "password"}
PATTERNS = [
    Pattern("sshd_accepted", ("syslog_bsd",), 3002, r"sshd\[\d+\]: Accepted \w+ for (\S+) from (\S+) port (\d+)", static=_SSH | {"status": "Success", "status_id": "1", "severity_id": "1"}, groups=("user", "src_endpoint.ip", "src_endpoint.port")),
    Pattern("sshd_failed", ("syslog_bsd",), 3002, r"sshd\[\d+\]: Failed \w+ for (?:invalid user )?(\S+) from (\S+) port (\d+)", static=_SSH | {"status": "Failure", "status_id": "2", "severity_id": "3"}, groups=("user", "src_endpoint.ip", "src_endpoint.port")),
    Pattern("firewall_traffic", ("cef",), 4001, r"\|src=(\S+) dst=(\S+) spt=(\d+) dpt=(\d+)", static={"activity_id": "6", "severity_id": "1"}, groups=("src_endpoint.ip", "dst_endpoint.ip", "src_endpoint.port", "dst_endpoint.port")),
    Pattern("console_login", ("json",), 3002, json_has=("eventName", "userName"), json_match={"eventName": "ConsoleLogin"}, static={"activity_id": "1", "severity_id": "1"}),
    Pattern("api_call", ("json",), 6003, json_has=("eventName", "sourceIPAddress"), static={"activity_id": "1", "severity_id": "1"}),
    Pattern("kv_action", ("kv",), 3002, r"user=(\S+) action=(\S+) src_ip=(\S+)", static={"activity_id": "1", "severity_id": "1"}, groups=("user", "activity_name", "src_endpoint.ip")),
    Pattern("web_access", ("clf",), 4002, r'^(\S+) \S+ (\S+) \[[^\]]+\] "(\S+) (\S+) \S+" (\d+)', static={"activity_id": "1", "severity_id": "1"}, groups=("src_endpoint.ip", "user", "http_request.http_method", "http_request.url.path", "http_response.code")),
]
DEFAULT = Library(PATTERNS)
