"""Schemas from files, validation with types, repairs only where errors fall; Sigma rules from files."""

import json

import pytest
from pyspark.sql import functions as F

from loomfield.operators import schemas, sigma

ATTRIBUTES = {"user": ("string", "required"), "count_id": ("integer", "optional"), "ratio": ("float", "optional"), "flag": ("boolean", "optional"), "device": ("object", "recommended"), "tags": ("array", "optional"), "class_uid": ("integer", "required")}
EVENT = {"user": "amy", "device.hostname": "h", "class_uid": "3002"}
CASES = [
    (3002, EVENT, True, set(), set()),
    (3002, {"device.hostname": "h"}, False, {("user", "missing_required"), ("class_uid", "missing_required")}, set()),
    (3002, EVENT | {"count_id": "7 items", "ratio": "x", "flag": "maybe"}, False, {("count_id", "wrong_type"), ("ratio", "wrong_type"), ("flag", "wrong_type")}, set()),
    (3002, EVENT | {"count_id": " 7", "ratio": "1.5", "flag": "TRUE", "tags": "[1]", "time": "now"}, True, set(), set()),
    (3002, EVENT | {"odd.part": "1", "category_uid": "4"}, True, set(), {("odd", "unknown_field"), ("category_uid", "invalid_value")}),
    (3002, EVENT | {"class_uid": "4001"}, False, {("class_uid", "invalid_value")}, set()),
    (77, {"user": "x"}, True, set(), {("class_uid", "unknown_field")}),
    (None, {"user": "x"}, False, {("class_uid", "missing_required")}, {("class_uid", "unknown_field")}),
    (3002, {}, False, {("user", "missing_required"), ("class_uid", "missing_required")}, set()),
]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("schemas")
    spec = {k: {"type": t, "requirement": r, "caption": k} for k, (t, r) in ATTRIBUTES.items()}
    (folder / "class_3002.json").write_text(json.dumps({"class_uid": 3002, "class_name": "Authentication", "attributes": spec}))
    (folder / "class_1.json").write_text(json.dumps({"class_uid": 1, "class_name": "Empty", "attributes": {}}))
    (folder / "other.json").write_text("{}")
    (folder / "class_bad.json").write_text("{not json")
    return schemas.read_schemas(spark, str(folder))


def _pairs(found):
    return {(e["field"], e["error_type"]) for e in found}


def test_validation(spark, table):
    events = spark.createDataFrame([(k, uid, event, "kept") for k, (uid, event, *_) in enumerate(CASES)], "id int, class_uid int, event map<string,string>, `a.b` string")
    got = {r["id"]: r for r in schemas.validate(events, table).collect()}
    assert [(got[k]["valid"], _pairs(got[k]["errors"]), _pairs(got[k]["warnings"])) for k in range(len(CASES))] == [tuple(c[2:]) for c in CASES]
    assert abs(got[0]["coverage"] - 3 / 7) < 1e-9 and got[6]["coverage"] == 0 and got[0]["a.b"] == "kept"
    strict = {r["id"]: r["valid"] for r in schemas.validate(events, table, strict=True).collect()}
    assert not strict[4] and strict[0]
    one = spark.createDataFrame([(1, {"x": "1"})], "class_uid int, event map<string,string>")
    assert schemas.validate(one, table).first()["coverage"] == 1.0


def test_repairs(spark, table):
    events = spark.createDataFrame([(k, uid, event) for k, (uid, event, *_) in enumerate(CASES)], "id int, class_uid int, event map<string,string>")
    got = {r["id"]: r for r in schemas.validate(events, table, fix=True).collect()}
    assert got[2]["fixed"] and got[2]["event"]["count_id"] == "7" and got[2]["event"]["ratio"] == "x" and _pairs(got[2]["errors"]) == {("ratio", "wrong_type"), ("flag", "wrong_type")}
    assert got[1]["fixed"] and got[1]["event"]["class_uid"] == "3002" and _pairs(got[1]["errors"]) == {("user", "missing_required")}
    assert not got[0]["fixed"] and got[0]["event"] == EVENT and not got[5]["fixed"] and not got[7]["fixed"]


RULES = {
    "a.yml": "title: Exact\nid: a\nlevel: critical\nlogsource: {category: Authentication}\ntags: [attack.T1110.001, attack.credential_access, attack.tactic]\ndetection:\n  s: {User: AMY}\n  condition: s\n",
    "sub/b.yml": "title: Wild\nlogsource: {category: authentication, service: sshd}\ndetection:\n  s: {user: [a*, 'b?b']}\n  condition: s\n",
    "c.yml": "title: Not\ndetection:\n  s: {SourceIp: '10.*'}\n  f: {user: bob}\n  condition: s and not f\n",
    "d.yml": "title: Ends\ndetection:\n  s: {src_ip|endswith: ['.1', '.3']}\n  condition: s\n",
    "e.yaml": "title: All of\ndetection:\n  s_1: {user: amy}\n  s_2: {src_ip|startswith: '10'}\n  condition: all of s_*\n",
    "f.yaml": "title: Unmapped\ndetection:\n  s: {EventID: 4}\n  condition: s\n",
    "g.yaml": "title: Other class\nlogsource: {category: dns_query}\ndetection:\n  s: {user: '*'}\n  condition: s\n",
    "h.yaml": "title: Two\ndetection:\n  s: {user: amy}\n  t: {user: bob}\n  condition: 1 of them\n---\ntitle: Dots are dots\ndetection:\n  s: {SourceIp: '10x0*'}\n  condition: s\n",
    "i.yaml": "title: Nested\ndetection:\n  selection:\n    inner: {User: [amy, bob], SourceIp: '10.0.0.?'}\n    plain: 4\n  condition: none\n",
    "bad.yml": "title: [unclosed\n", "empty.yml": "", "list.yml": "- 1\n",
}
EVENTS = [(1, 3002, {"user": "amy", "src_endpoint.ip": "10.0.0.1"}), (2, 3002, {"user": "bob", "src_endpoint.ip": "10.0.0.22"}), (3, 4001, {"user": "amy"}), (4, 4001, {"src_endpoint.ip": "192.168.0.3"}), (5, None, {}), (6, 4003, {"user": "x"})]


@pytest.fixture(scope="module")
def rules(tmp_path_factory):
    folder = tmp_path_factory.mktemp("rules")
    (folder / "sub").mkdir()
    for name, text in RULES.items():
        (folder / name).write_text(text)
    return sigma.read_rules(str(folder))


@pytest.fixture(scope="module")
def events(spark):
    rows = [(k, uid, event, f"2026-01-01 00:00:0{k}") for k, uid, event in EVENTS]
    return spark.createDataFrame(rows, "id int, class_uid int, event map<string,string>, at string").withColumns({"status_id": F.lit(1), "activity_id": F.lit(1)})


def test_rules_from_files(rules, events):
    assert [r.title for r in rules] == ["Exact", "Not", "Ends", "Wild", "All of", "Unmapped", "Other class", "Two", "Dots are dots", "Nested"]
    assert rules[0].techniques == ["T1110.001"] and rules[0].tactics == ["TA0006"] and rules[0].class_uid == 3002 and rules[1].class_uid is None
    found = sorted((r["title"], r["event_ids"][0]) for r in sigma.alerts(events, rules, "at", "id").collect())
    assert found == sorted([("Exact", "1"), ("Not", "1"), ("Ends", "1"), ("Ends", "4"), ("Wild", "1"), ("Wild", "2"), ("All of", "1"), ("Two", "1"), ("Two", "2"), ("Two", "3"), ("Other class", "6")])


def test_selection_semantics(rules, events):
    """Only nested blocks of `selection` are read: rules without one hold for their class, fields at its first level too."""
    own = [r for r in rules if r.title in ("Nested", "Exact")]
    found = sorted((r["title"], r["event_ids"][0]) for r in sigma.alerts(events, own, "at", "id", semantics="selection").collect())
    assert found == [("Exact", "1"), ("Exact", "2"), ("Nested", "1")]


def test_alerts(rules, events):
    one = sigma.alerts(events, rules[:1], "at", "id").first()
    assert (one["severity"], one["techniques"], one["rule_id"], one["correlation_type"]) == ("critical", ["T1110.001"], "a", "sigma")
    assert [(o["name"], o["value"]) for o in one["observables"]][-2:] == [("src_endpoint.ip", "10.0.0.1"), ("user.name", "amy")]
    assert sigma.alerts(events, [], "at", "id").isEmpty()
    from loomfield.operators.sequences import Sequence

    pattern = Sequence("Pair", "", 60, ("user.name",), ({"class_uid": 3002}, {"class_uid": 4001}), ("T1",))
    both = sigma.correlate(events, rules[:1], [pattern], "at", "id").collect()
    assert sorted((r["correlation_type"], r["title"], r["event_count"]) for r in both) == [("pattern", "Pair", 2), ("sigma", "Exact", 1)]
    assert [(o["name"], o["value"]) for r in both if r["title"] == "Pair" for o in r["observables"]] == [("user.name", "amy")]
