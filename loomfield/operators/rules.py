"""Rules over events: filter packs, schema validation, observables, triage, Sigma selections, sequences."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import fenced

# Filter packs, rules in order.
PACKS = {
    "all-pass": [("keep", "all")],
    "noise-reduction": [("drop", {"classes": [0]}), ("drop", {"severity_id": {"lte": 0}}), ("drop", {"confidence": {"lte": 0.3}}), ("keep", "all")],
    "pci-dss": [
        ("keep", {"classes": [3002, 3003, 3005, 3001, 3006]}), ("keep", {"classes": [4001, 4007, 4005, 4006]}), ("keep", {"classes": [2001, 2002, 2004]}),
        ("keep", {"classes": [1001, 1007]}), ("keep", {"severity_id": {"gte": 3}}), ("drop", {"classes": [0]}), ("keep", "all"),
    ],
    "security-focused": [
        ("keep", {"categories": [2]}), ("keep", {"categories": [3]}), ("keep", {"classes": [4001, 4002, 4003, 4007, 4005, 4006, 4013]}),
        ("keep", {"classes": [1004, 1005, 1007, 1008]}), ("keep", {"severity_id": {"gte": 4}}), ("drop", "all"),
    ],
}


def condition(what, class_uid: Column, severity: Column, confidence: Column) -> Column:
    """A rule's condition: "all", or all of its parts; parts that aren't known don't count."""
    if what == "all":
        return F.lit(True)
    if not isinstance(what, dict):
        return F.lit(False)
    out = F.lit(True)
    if "classes" in what:
        out = out & class_uid.isin(what["classes"])
    if "categories" in what:
        out = out & F.floor(class_uid / 1000).isin(what["categories"])
    for key, value in (("severity_id", severity), ("confidence", confidence)):
        for op, bound in (what[key] if isinstance(what.get(key), dict) else {"eq": what[key]} if key in what else {}).items():
            out = out & (value >= bound if op == "gte" else value <= bound if op == "lte" else value == bound)
    return out


def evaluate_pack(rules: list[tuple[str, object]], class_uid: Column, severity: Column, confidence: Column) -> tuple[Column, Column]:
    """(action, number of the rule): the first rule that holds; without one keep, -1."""
    action, index = None, None
    for k, (verb, what) in enumerate(rules):
        holds = condition(what, class_uid, severity, confidence)
        action = F.when(holds, verb) if action is None else action.when(holds, verb)
        index = F.when(holds, k) if index is None else index.when(holds, k)
    return action.otherwise("keep"), index.otherwise(-1)


def two_pass(rules, class_uid: Column, severity: Column, confidence: Column) -> Column:
    """Decided with severity 1 first, and again with the true one where it is neither null nor 0."""
    first, second = evaluate_pack(rules, class_uid, F.lit(1), confidence)[0], evaluate_pack(rules, class_uid, severity, confidence)[0]
    return F.when(severity.isNotNull() & (severity != 0), second).otherwise(first)


# Required and all attributes of some classes.
REQUIRED = {3002: ["activity_id", "user", "src_endpoint.ip", "status"], 4001: ["activity_id", "src_endpoint.ip", "dst_endpoint.ip"], 4002: ["activity_id", "http_request.http_method", "http_request.url.path"], 6003: ["activity_id", "api.operation", "src_endpoint.ip"]}
ATTRIBUTES = {3002: REQUIRED[3002] + ["auth_protocol", "status_id", "severity_id", "actor.user.name"], 4001: REQUIRED[4001] + ["src_endpoint.port", "dst_endpoint.port", "severity_id"], 4002: REQUIRED[4002] + ["http_response.code", "src_endpoint.ip", "severity_id"], 6003: REQUIRED[6003] + ["actor.user.name", "severity_id"]}


def validate(events: DataFrame) -> DataFrame:
    """events with missing (required paths that aren't there), valid, coverage (share of the class's attributes)."""
    table = lambda t: F.create_map(*(F.lit(x) if isinstance(x, int) else F.array(*map(F.lit, x)) for pair in t.items() for x in pair))
    paths, none = F.map_keys("event"), F.array().cast("array<string>")
    need, every = (F.coalesce(F.element_at(table(t), F.col("class_uid")), none) for t in (REQUIRED, ATTRIBUTES))
    out = events.withColumn("missing", F.array_except(need, paths))
    return out.withColumn("valid", F.size("missing") == 0).withColumn("coverage", F.when(F.size(every) > 0, F.size(F.array_intersect(every, paths)) / F.size(every)).otherwise(0.0))


# Observable types (number, name) with their paths; the types of other paths by their ends, the first that fits.
OBSERVABLE_TYPES = {
    (2, "IP Address"): ["src_endpoint.ip", "dst_endpoint.ip", "device.ip"],
    (1, "Hostname"): ["device.hostname", "src_endpoint.hostname", "dst_endpoint.hostname", "query.hostname", "http_request.url.hostname"],
    (11, "Port"): ["src_endpoint.port", "dst_endpoint.port"], (4, "User Name"): ["user", "actor.user.name"], (10, "Resource UID"): ["actor.user.uid", "session.uid", "finding_info.uid", "metadata.uid"],
    (9, "Process Name"): ["process.name", "process.parent_process.name"], (15, "Process ID"): ["process.pid", "process.parent_process.pid"], (13, "Command Line"): ["process.cmd_line"],
    (7, "File Name"): ["process.file.path", "file.name", "file.path"], (8, "Hash"): ["file.hashes.value"], (6, "URL String"): ["http_request.url.path"], (16, "HTTP User-Agent"): ["http_request.user_agent"],
    (3, "MAC Address"): ["device.mac", "src_endpoint.mac"], (5, "Email Address"): ["email.from", "email.to"],
}
ENDS = {".ip": (2, "IP Address"), ".hostname": (1, "Hostname"), ".port": (11, "Port"), ".mac": (3, "MAC Address"), ".name": (9, "Process Name"), ".pid": (15, "Process ID"), ".cmd_line": (13, "Command Line"), ".path": (7, "File Name"), ".user_agent": (16, "HTTP User-Agent")}
ABSENT = ["", "None", "unknown", "null", "0"]
# Paths that are never observables.
EXCLUDED = [
    "class_uid", "class_name", "category_uid", "category_name", "activity_id", "activity_name", "severity_id", "severity", "type_uid", "type_name", "status_id", "status", "message", "raw_data",
    "time", "start_time", "end_time", "metadata.version", "metadata.product.name", "metadata.product.vendor_name", "metadata.event_code", "metadata.logged_time",
]


def observable_type(path: Column) -> Column:
    """(type_id, type) of a path; null if it is no observable."""
    table = {p: t for t, paths in OBSERVABLE_TYPES.items() for p in paths}
    made = lambda t: F.struct(F.lit(t[0]).alias("type_id"), F.lit(t[1]).alias("type"))
    known = F.element_at(F.create_map(*(x for p, t in table.items() for x in (F.lit(p), made(t)))), path)
    by_end = F.coalesce(*(F.when(path.endswith(end), made(t)) for end, t in ENDS.items()))
    return F.when(path.isin(EXCLUDED), None).otherwise(F.coalesce(known, by_end))


def observables(event: Column) -> Column:
    """(name, type_id, type, value) of an event map's observable paths in path order, each (type_id, value) once."""
    named = F.transform(F.array_sort(F.map_entries(event)), lambda e: F.struct(e["key"].alias("name"), observable_type(e["key"]).alias("t"), e["value"].alias("value")))
    known = F.filter(named, lambda x: x["t"].isNotNull() & ~x["value"].isin(ABSENT))
    made = F.transform(known, lambda x: F.struct(x["name"].alias("name"), x["t"]["type_id"].alias("type_id"), x["t"]["type"].alias("type"), x["value"].alias("value")))
    return F.filter(made, lambda x, i: ~F.exists(F.slice(made, 1, i), lambda y: (y["type_id"] == x["type_id"]) & (y["value"] == x["value"])))


# Relevance of (class, activity), default 0.5; number of telling fields of a class, default 10; reputations, default 0.5.
SUBTYPE = {
    3002: {1: 1.0, 2: 0.6, 3: 0.4, 4: 0.4}, 3001: {1: 1.0, 2: 0.9, 3: 0.8, 4: 0.7, 5: 0.6, 6: 0.9}, 3003: {1: 0.8, 2: 0.8}, 1007: {1: 0.9, 2: 0.3}, 4001: {1: 0.7, 2: 0.3, 3: 0.4, 5: 0.5},
    4003: {1: 0.6, 2: 0.5}, 4002: {1: 0.6, 2: 0.5}, 2004: {1: 1.0, 2: 0.4}, 6003: {1: 0.8, 2: 0.7, 3: 0.8, 4: 0.9}, 1001: {1: 0.1, 2: 0.1}, 1006: {1: 0.8, 2: 0.4, 3: 0.7}, 3004: {1: 0.9, 2: 0.9}, 3005: {1: 0.9},
}
RICH_MAX = {3002: 12, 3001: 8, 3003: 8, 1007: 12, 4001: 12, 4003: 8, 4002: 10, 2004: 10, 6003: 8, 1001: 4, 1006: 6, 3004: 6, 3005: 6}
REPUTATION = {
    "sysmon": 0.95, "windows_security": 0.9, "palo_alto": 0.9, "crowdstrike": 0.95, "okta": 0.85, "duo": 0.85, "suricata": 0.9, "zeek": 0.85, "sshd": 0.75, "auditd": 0.8, "firewall": 0.8,
    "dns_server": 0.6, "web_server": 0.5, "apache": 0.5, "nginx": 0.5, "application": 0.4, "healthcheck": 0.1, "heartbeat": 0.05, "metric": 0.1, "debug": 0.05,
}
TELLING = [
    "user", "actor.user.name", "actor.user.uid", "src_endpoint.ip", "src_endpoint.port", "dst_endpoint.ip", "dst_endpoint.port", "process.name", "process.cmd_line", "process.pid",
    "finding_info.title", "severity_id", "status", "status_id", "auth_protocol", "connection_info.protocol_name", "http_request.url.path", "http_request.http_method", "http_response.code",
    "query.hostname", "traffic.bytes_in", "traffic.bytes_out", "api.operation", "api.service.name", "privileges", "session.uid", "device.hostname",
]
# Techniques by class, with activity filter (empty: any) and required paths.
TECHNIQUES = [
    ("T1078", 3002, [1], ["user", "src_endpoint.ip", "status"]), ("T1133", 3002, [1], ["user", "src_endpoint.ip"]), ("T1110", 3002, [1], ["user", "src_endpoint.ip", "status"]),
    ("T1021", 3002, [1], ["user", "src_endpoint.ip"]), ("T1059", 1007, [1], ["process.name", "process.cmd_line"]), ("T1098", 6003, [], ["api.operation"]),
    ("T1046", 4001, [1, 2, 6], ["src_endpoint.ip", "dst_endpoint.ip", "dst_endpoint.port"]), ("T1071", 4001, [], ["src_endpoint.ip", "dst_endpoint.ip"]),
    ("T1571", 4001, [1, 2, 6], ["dst_endpoint.ip", "dst_endpoint.port"]), ("T1572", 4001, [], ["src_endpoint.ip", "dst_endpoint.ip", "dst_endpoint.port"]),
    ("T1595", 4001, [], ["src_endpoint.ip", "dst_endpoint.ip"]), ("T1190", 4002, [], ["http_request.url.path", "src_endpoint.ip"]),
]


def present(event: Column, path: str) -> Column:
    v = F.element_at(event, path)
    return F.coalesce(~v.isin("", "None", "unknown", "0"), F.lit(False))


def relevance(events: DataFrame, source: Column | None = None) -> DataFrame:
    """events with subtype, richness, attack, reputation, score and techniques."""
    number = lambda table: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    pairs = {c * 1000 + a: s for c, by in SUBTYPE.items() for a, s in by.items()}
    event = F.col("event")
    rich = sum((F.when(present(event, p), 1).otherwise(0) for p in TELLING), F.lit(0))
    found = F.array_compact(F.array(*(
        F.when((F.col("class_uid") == c) & (F.col("activity_id").isin(acts) if acts else F.lit(True)) & F.forall(F.array(*(present(event, p) for p in need)), lambda x: x), t) for t, c, acts, need in TECHNIQUES
    )))
    known = F.lower(F.replace(source if source is not None else F.lit("application"), F.lit(" "), F.lit("_")))
    out = fenced(events, **{
        "subtype": F.coalesce(F.element_at(number(pairs), F.col("class_uid") * 1000 + F.col("activity_id")), F.lit(0.5)),
        "richness": F.least(rich / F.coalesce(F.element_at(number(RICH_MAX), F.col("class_uid")), F.lit(10)), F.lit(1.0)),
        "techniques": found, "reputation": F.coalesce(F.element_at(number(REPUTATION), known), F.lit(0.5)),
    })
    n = F.size("techniques")
    out = out.withColumn("attack", F.when(n == 0, 0.0).otherwise(F.least(0.25 + 0.25 * n, F.lit(1.0))))
    return out.withColumn("score", 0.4 * F.col("subtype") + 0.3 * F.col("richness") + 0.2 * F.col("attack") + 0.1 * F.col("reputation"))


SECURITY_CLASSES = [2004, 2001, 2002, 3002, 3005, 4001, 1007]


def tier(score: Column, class_uid: Column) -> Column:
    bar = F.when(class_uid.isin(SECURITY_CLASSES), 0.6).otherwise(0.7)
    return F.when(score >= bar, "security").when(score >= 0.3, "operational").when(score >= 0.1, "compliance").otherwise("noise")


def sigma_value(value: Column, wanted: str) -> Column:
    """Case-insensitive; * is any text, ? any character."""
    pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in wanted)
    return value.rlike(f"(?is)^{pattern}$")


def sigma_selection(selection: dict[str, object], field: dict[str, Column]) -> Column:
    """All fields must match; a list is any of its values; |contains, |startswith, |endswith and |all change the test. Unknown fields: false."""
    out = F.lit(True)
    for key, wanted in selection.items():
        name, *changes = key.split("|")
        values = [str(v) for v in (wanted if isinstance(wanted, list) else [wanted])]
        wrap = {"contains": "*{}*", "startswith": "{}*", "endswith": "*{}"}
        shape = next((wrap[c] for c in changes if c in wrap), "{}")
        tests = [sigma_value(field[name], shape.format(v)) for v in values] if name in field else [F.lit(False)]
        joined = tests[0]
        for t in tests[1:]:
            joined = joined & t if "all" in changes else joined | t
        out = out & F.coalesce(joined, F.lit(False))
    return out


def sigma_rule(detection: dict[str, object], field: dict[str, Column]) -> Column:
    """detection: named selections and a condition of names, and, or, not, parentheses, "1 of x*", "all of x*"."""
    parts = {k: sigma_selection(v, field) for k, v in detection.items() if isinstance(v, dict)}
    words = re.findall(r"\(|\)|[\w*]+", str(detection.get("condition", " and ".join(parts))))

    def atom() -> Column:
        word = words.pop(0)
        if word == "not":
            return ~atom()
        if word == "(":
            inner = either()
            words.pop(0)
            return inner
        if word in ("1", "any", "all") and words and words[0] == "of":
            words.pop(0)
            name = words.pop(0)
            own = [c for k, c in parts.items() if name == "them" or re.fullmatch(name.replace("*", ".*"), k)] or [F.lit(False)]
            out = own[0]
            for c in own[1:]:
                out = out & c if word == "all" else out | c
            return out
        return parts.get(word, F.lit(False))

    def both() -> Column:
        out = atom()
        while words and words[0] == "and":
            words.pop(0)
            out = out & atom()
        return out

    def either() -> Column:
        out = both()
        while words and words[0] == "or":
            words.pop(0)
            out = out | both()
        return out

    return either()


def sequences(events: DataFrame, key: list[str], time: str, order: str, steps: list[Column], window_seconds: float) -> DataFrame:
    """key, n_alerts: how often each key's events, in time order, go through the steps within the window.

    The first step opens a state; once the window since its opening (or since the last alert) has passed, any event of the
    key that is a step resets it; an event of the awaited step advances; the last step alerts and starts anew. The step
    events are dealt by key, sorted by key and time, and folded batch by batch: a hot key costs its task time, but of
    its events no more than a batch is held. Null keys have no state.
    """
    mask = sum((F.when(F.coalesce(s, F.lit(False)), 1 << k).otherwise(0) for k, s in enumerate(steps)), F.lit(0))
    own = events.select(*key, F.col(time).cast("double").alias("__t"), F.col(order).alias("__o"), mask.alias("__m")).where(F.col("__m") > 0)
    for k in key:
        own = own.where(F.col(k).isNotNull())
    kinds = own.select(*key).schema
    rows = own.repartition(*key).sortWithinPartitions(*key, "__t", "__o", "__m").drop("__o")
    return rows.mapInArrow(_alerts(key, len(steps), window_seconds), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "n_alerts long"]))


def _alerts(key: list[str], steps: int, window_seconds: float):
    """Folds rows (key, __t, __m) that come sorted; the state of the last key is carried from batch to batch."""

    def run(batches):
        now, head, opened, step, first, alerts = None, None, False, 0, 0.0, 0
        for batch in batches:
            heads, found = [], []
            columns = [batch.column(k).to_pylist() for k in key]
            for i, (own, t, m) in enumerate(zip(zip(*columns, strict=True), batch.column("__t").to_pylist(), batch.column("__m").to_pylist(), strict=True)):
                if own != now:
                    if now is not None:
                        heads.append(head)
                        found.append(alerts)
                    now, head, opened, step, first, alerts = own, [batch.column(k).slice(i, 1) for k in key], False, 0, 0.0, 0
                late = opened and t is not None and first is not None and t - first > window_seconds
                if late:
                    step = 0
                if late or not opened:
                    first = t
                if m >> step & 1:
                    opened, step = True, step + 1
                    if step == steps:
                        step, first, alerts = 0, t, alerts + 1
            if found:
                yield pa.RecordBatch.from_arrays([*(pa.concat_arrays(c) for c in zip(*heads, strict=True)), pa.array(found, pa.int64())], names=[*key, "n_alerts"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([*head, pa.array([alerts], pa.int64())], names=[*key, "n_alerts"])

    return run


def best_rows(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
