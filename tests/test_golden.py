"""Golden entries: every gate fails on some row, values in lines, times, coherence."""

import pytest
from pyspark.sql import functions as F

from loomfield.operators import golden, schemas

SCHEMA = "id int, raw_log string, class_uid int, event map<string,string>, confidence map<string,string>"
LINE = "2026-01-02T03:04:05Z sshd: login of amy from 10.0.0.1 port 4022"
GOOD = {"user": "amy", "src_endpoint.ip": "10.0.0.1", "src_endpoint.port": "4022", "time": "2026-01-02T03:04:05Z", "activity_id": "1", "severity_id": "1"}
BY_PATTERN = dict.fromkeys(GOOD, "pattern")


def _rows():
    known = "known line " + LINE
    return [
        (0, LINE, 3002, GOOD, BY_PATTERN, None),
        (1, LINE + " ", 3002, GOOD | {"user": "Amy"}, BY_PATTERN, None),  # case doesn't matter
        (2, known, 3002, GOOD, BY_PATTERN, "known"),
        (3, LINE, 3002, {k: v for k, v in GOOD.items() if k != "user"}, BY_PATTERN, "schema"),
        (4, LINE, 3002, GOOD, BY_PATTERN | dict.fromkeys(["time", "src_endpoint.ip", "src_endpoint.port", "activity_id"], "enrichment"), "fields"),
        (5, LINE, 3002, GOOD | {"user": "bob", "src_endpoint.ip": "9.9.9.9", "src_endpoint.port": "1", "time": "1950-01-01T00:00:00Z", "status": "failure", "status_id": "1", "x": "gone", "y": "lost", "z": "too"}, BY_PATTERN | dict.fromkeys("xyz", "alias"), "trust"),
        (6, None, 3002, None, None, "fields"),
    ]


@pytest.fixture(scope="module")
def found(spark):
    table = spark.createDataFrame([(3002, "Authentication", "user", "string", "required")], schemas.TABLE)
    known = spark.createDataFrame([("known line " + LINE,), (None,)], "raw_log string")
    events = spark.createDataFrame([r[:5] for r in _rows()], SCHEMA)
    return {r["id"]: r for r in golden.candidates(events, table, known).collect()}


def test_gates(found):
    assert {k: found[k]["rejected"] for k in (0, 1, 2, 3, 4, 5)} == {r[0]: r[5] for r in _rows() if r[0] < 6} and len(found) == 7
    assert found[0]["trust"] == 1.0 and found[5]["gates"]["time"] == 0 and found[5]["gates"]["in_line"] < 0.6 and found[5]["gates"]["coherence"] < 1
    assert found[6]["rejected"] is not None


def test_values_in_lines(spark):
    rows = [("amy", True), ("AMY", True), ("x", True), ("bob", False), ("4022.0", True), ("17.5", False), ("true", False), ("false", True), ("", True)]
    line = "login failed of amy port 4022"
    got = spark.createDataFrame(rows, "v string, want boolean").withColumn("got", golden.in_line(F.col("v"), F.lit(line))).collect()
    assert [r["v"] for r in got if r["got"] != r["want"]] == []


def test_times(spark):
    rows = [("946684799", False), ("946684800", True), ("1924992000", False), ("2026-01-02T03:04:05Z", True), ("1999-12-31T00:00:00", False), ("Jan  5 10:00:00", True), ("gibberish that is far too long", False)]
    got = spark.createDataFrame(rows, "v string, want boolean").withColumn("got", golden.timely(F.col("v"))).collect()
    assert [r["v"] for r in got if r["got"] != r["want"]] == []


def test_invented_values(spark):
    confidence = {"user": "pattern", "x": "alias", "y": "enrichment", "d": "alias", "activity_id": "pattern"}
    one = spark.createDataFrame([("login of amy unknown", {"user": "amy", "x": "nowhere", "y": "nowhere", "d": "unknown", "activity_id": "99"}, confidence)], "raw_log string, event map<string,string>, confidence map<string,string>")
    assert golden.invented(one).first()["invented"] == {"x": "nowhere", "d": "unknown"}
