"""Sigma rules from YAML files, compiled to one column of matched rules, and alerts.

A rule is asked only of events of its logsource's class (rules of an unknown category of all). `sigma`: selections, the
condition and modifiers as Sigma defines them. `selection`: only what stands inside a block named `selection` counts, its
fields at the first level being taken as true and nested blocks as all of their fields, a list as any of its values; the
condition and modifiers are not read. Values compare as text, without case, with * and ? as wildcards; a field that has no
path, or that the event lacks, doesn't match.
"""

from __future__ import annotations

import glob
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import observables, sigma_rule, sigma_value
from .sequences import Sequence, of_event
from .sequences import alerts as sequence_alerts

# Class of a logsource's category; paths of field names, of Windows and of all systems; tactics by tag.
CLASS_OF = {
    "process_creation": 1007, "network_connection": 4001, "dns_query": 4003, "file_create": 7003, "registry_add": 7001, "registry_set": 7001, "registry_delete": 7001, "user_account": 3001,
    "authentication": 3002, "logon": 3002, "privilege": 3005, "file_delete": 7003, "ps_script": 1007, "pipe_created": 1007, "wmi_event": 1007, "sysmon": 1001, "security": 3002, "system": 1001,
}
WINDOWS = {
    "Image": "process.file.path", "ProcessName": "process.name", "ProductName": "process.product.name", "Description": "process.description", "Company": "process.company.name",
    "OriginalFileName": "process.file.name", "CommandLine": "process.cmd_line", "CurrentDirectory": "process.current_directory", "User": "user.name", "SubjectUserName": "actor.user.name",
    "SubjectDomainName": "actor.user.domain", "ParentImage": "process.parent_process.file.path", "ParentProcessName": "process.parent_process.name", "ParentCommandLine": "process.parent_process.cmd_line",
    "ParentUser": "actor.user.name", "ProcessId": "process.pid", "ParentProcessId": "process.parent_process.pid", "Hashes": "process.file.hash", "Signature": "process.file.signature", "Signed": "process.file.signed",
    "DestinationIp": "dst_endpoint.ip", "DestinationPort": "dst_endpoint.port", "SourceIp": "src_endpoint.ip", "SourcePort": "src_endpoint.port", "Protocol": "connection_info.protocol_name",
    "Hostname": "device.hostname", "Ip": "src_endpoint.ip", "Port": "src_endpoint.port", "Query": "query.hostname", "QueryName": "query.hostname", "QueryType": "query.type", "Response": "answers",
    "TargetFilename": "file.path", "CreationUtcTime": "file.created_time", "FileSize": "file.size", "Key": "registry.key.path", "Value": "registry.value.name", "Data": "registry.value.data",
    "TargetUserName": "user.name", "TargetDomainName": "user.domain", "TargetLogonId": "user.session.uid", "IpAddress": "src_endpoint.ip", "IpPort": "src_endpoint.port",
    "AuthenticationPackageName": "auth_protocol", "Process": "process.name",
}
GENERIC = {
    "user": "user.name", "username": "user.name", "userName": "user.name", "client_ip": "src_endpoint.ip", "server_ip": "dst_endpoint.ip", "src_ip": "src_endpoint.ip", "dst_ip": "dst_endpoint.ip",
    "source_ip": "src_endpoint.ip", "destination_ip": "dst_endpoint.ip", "src_port": "src_endpoint.port", "dst_port": "dst_endpoint.port", "source_port": "src_endpoint.port",
    "destination_port": "dst_endpoint.port", "hostname": "device.hostname", "host": "device.hostname", "path": "file.path", "filename": "file.name", "command": "process.cmd_line", "cmd": "process.cmd_line",
    "pid": "process.pid", "ppid": "process.parent_process.pid", "name": "process.name", "hash": "file.hash", "md5": "file.hash.md5", "sha1": "file.hash.sha1", "sha256": "file.hash.sha256",
}
TACTICS = {
    "defense_evasion": "TA0005", "persistence": "TA0003", "privilege_escalation": "TA0004", "credential_access": "TA0006", "lateral_movement": "TA0008", "initial_access": "TA0001", "execution": "TA0002",
    "discovery": "TA0007", "collection": "TA0009", "command_and_control": "TA0011", "exfiltration": "TA0010", "impact": "TA0040",
}
LEVELS = ("critical", "high", "medium", "low")


def path_of(name: str) -> str | None:
    """A Sigma field's path: the name as it stands, else without case; of two maps the Windows one counts."""
    both = GENERIC | WINDOWS
    return both.get(name) or next((path for known, path in both.items() if known.lower() == name.lower()), None)


@dataclass(frozen=True)
class Rule:
    title: str
    rule_id: str
    level: str
    description: str
    logsource: dict = field(default_factory=dict)
    detection: dict = field(default_factory=dict)
    tags: tuple[str, ...] = ()

    @property
    def class_uid(self) -> int | None:
        return CLASS_OF.get(str(self.logsource.get("category") or "").lower())

    @property
    def techniques(self) -> list[str]:
        """Ids of tags like attack.t1110.001; a tactic's name that begins with t isn't one."""
        names = [t.lower().removeprefix("attack.") for t in self.tags if t.lower().startswith("attack.t")]
        return [n.upper() for n in names if n[1:2].isdigit()]

    @property
    def tactics(self) -> list[str]:
        return [TACTICS[n] for t in self.tags if t.lower().startswith("attack.") and (n := t.lower().removeprefix("attack.")) in TACTICS]


def rule_of(raw: object) -> Rule | None:
    """A rule of a YAML document; None if it is no mapping with a detection."""
    if not isinstance(raw, dict) or not isinstance(raw.get("detection"), dict):
        return None
    text = lambda key, other: str(raw.get(key) or other)
    return Rule(text("title", "Untitled"), text("id", ""), text("level", "medium"), text("description", ""), dict(raw.get("logsource") or {}), raw["detection"], tuple(map(str, raw.get("tags") or ())))


def read_rules(folder: str) -> list[Rule]:
    """The rules of all .yml, then all .yaml files below a folder, each in order of name; files that can't be read are left out."""
    import yaml

    out = []
    for kind in ("yml", "yaml"):
        for name in sorted(glob.glob(f"{folder}/**/*.{kind}", recursive=True)):
            try:
                with open(name, encoding="utf-8") as f:
                    out += [r for raw in yaml.safe_load_all(f) if (r := rule_of(raw)) is not None]
            except (yaml.YAMLError, UnicodeDecodeError):
                continue
    return out


class _Fields(dict):
    """Columns of fields by Sigma name, made when asked for."""

    def __init__(self, value: Callable[[str], Column]):
        super().__init__()
        self.value = value

    def __contains__(self, name: object) -> bool:
        return path_of(str(name)) is not None

    def __getitem__(self, name: str) -> Column:
        return self.value(path_of(name)).cast("string")


def _inside(block: object, fields: _Fields) -> Column:
    """`selection` semantics of one block: all fields of a mapping, all blocks of a list; else true."""
    out = F.lit(True)
    if isinstance(block, list):
        for x in block:
            out = out & _inside(x, fields)
    elif isinstance(block, dict):
        for name, wanted in block.items():
            any_ = F.lit(False)
            for v in (wanted if isinstance(wanted, list) else [wanted]) if name in fields else ():
                any_ = any_ | sigma_value(fields[name], str(v))
            out = out & F.coalesce(any_, F.lit(False))
    return out


def holds(rule: Rule, value: Callable[[str], Column] = of_event, semantics: str = "sigma") -> Column:
    """Whether the rule's detection matches, its class aside."""
    fields = _Fields(value)
    if semantics == "sigma":
        return F.coalesce(sigma_rule(rule.detection, fields), F.lit(False))
    own, out = rule.detection.get("selection"), F.lit(True)
    for block in own.values() if isinstance(own, dict) else ():
        out = out & _inside(block, fields)
    return F.coalesce(out, F.lit(False))


def matched(rules: list[Rule], class_uid: Column, value: Callable[[str], Column] = of_event, semantics: str = "sigma") -> Column:
    """The numbers of the rules that an event matches; only the rules of its class are evaluated."""
    of_class: dict[int | None, list[int]] = {}
    for k, r in enumerate(rules):
        of_class.setdefault(r.class_uid, []).append(k)
    tests = {k: F.when(holds(r, value, semantics), F.lit(k)) for k, r in enumerate(rules)}
    found = lambda own: F.array_compact(F.array(*(tests[k] for k in sorted(own)))) if own else F.array().cast("array<int>")
    anywhere, out = of_class.pop(None, []), None
    for uid, own in of_class.items():
        test = class_uid == uid
        out = F.when(test, found(own + anywhere)) if out is None else out.when(test, found(own + anywhere))
    return found(anywhere) if out is None else out.otherwise(found(anywhere))


ALERT = ["correlation_type", "title", "rule_id", "severity", "description", "timestamp", "event_ids", "event_count", "observables", "techniques", "tactics"]


def alerts(events: DataFrame, rules: list[Rule], time: str, order: str, value: Callable[[str], Column] = of_event, semantics: str = "sigma") -> DataFrame:
    """One alert for each event and rule that matches it; observables are the event's, then its source address and user."""
    pick = lambda get: F.element_at(F.array(*(get(r) for r in rules)), F.col("__rule") + 1)
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    if not rules:
        rules, events = [Rule("", "", "", "", {}, {"none": {}, "condition": "none"})], events.where("false")
    own = events.withColumn("__rule", F.explode(matched(rules, F.col("class_uid"), value, semantics)))
    seen = F.transform(observables(F.col("event")), lambda o: F.struct(o["name"].alias("name"), o["type"].alias("type"), o["value"].alias("value")))
    more = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), value(name).cast("string").alias("value")) for name, kind in (("src_endpoint.ip", "IP Address"), ("user.name", "User Name"))))
    return own.select(
        F.lit("sigma").alias("correlation_type"), pick(lambda r: F.lit(r.title)).alias("title"), pick(lambda r: F.lit(r.rule_id)).alias("rule_id"), pick(lambda r: F.lit(r.level if r.level in LEVELS else "medium")).alias("severity"),
        pick(lambda r: F.lit(r.description)).alias("description"), F.col(time).cast("timestamp").alias("timestamp"), F.array(F.col(order).cast("string")).alias("event_ids"), F.lit(1).alias("event_count"),
        F.concat(seen, F.filter(more, lambda o: o["value"].isNotNull())).alias("observables"), pick(lambda r: texts(r.techniques)).alias("techniques"), pick(lambda r: texts(r.tactics)).alias("tactics"),
    )


def correlate(events: DataFrame, rules: list[Rule], patterns: list[Sequence], time: str, order: str, value: Callable[[str], Column] = of_event) -> DataFrame:
    """The alerts of all detectors: Sigma rules and sequences."""
    out = alerts(events, rules, time, order, value)
    if not patterns:
        return out
    names = F.element_at(F.array(*(F.array(*map(F.lit, p.key)) for p in patterns)), F.array_position(F.array(*(F.lit(p.name) for p in patterns)), F.col("title")).cast("int"))
    found = sequence_alerts(events, patterns, time, order, value)
    found = found.withColumns({"correlation_type": F.lit("pattern"), "rule_id": F.lit(None).cast("string"), "observables": F.zip_with(names, "key", lambda n, v: F.struct(n.alias("name"), F.lit(None).cast("string").alias("type"), v.alias("value")))})
    return out.unionByName(found.select(*ALERT))
