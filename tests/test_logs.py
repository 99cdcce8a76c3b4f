import pytest
from pyspark.sql import functions as F

from loomfield.functions import coerce
from loomfield.operators import rules
from loomfield.operators.detect_format import detect_format
from loomfield.operators.preparse import preparse

from oracle import compare  # noqa: I001

LINES = [
    ("<13>1 2025-01-02T03:04:05Z mx9 cron 81 ID1 - nightly job done", "syslog_rfc5424"),
    ("<86>Feb  2 04:05:06 gate2 login: session closed for ann", "syslog_rfc3164"),
    ("Feb  2 04:05:06 gate2 cron[412]: job backup started", "syslog_bsd"),
    ("CEF:0|Acme|Sensor|3.1|77|Probe|4|src=10.4.5.6", "cef"),
    ("LEEF:2.0|Acme|Sensor|3.1|77|src=10.4.5.6", "leef"),
    ('{"kind": "probe", "ok": true}', "json"),
    ('{"EventID": 4688, "Computer": "ws4"}', "evtx_json"),
    ("at=2025-02-02 what=logout who=ann how=web", "kv"),
    ("7,ann,10.4.5.6,logout,web", "csv"),
    ("k1\tk2\tk3\tk4\tk5\tk6\tk7", "tsv"),
    ("#Fields: time cs-uri", "w3c"),
    ('10.4.5.6 - ann [02/Feb/2025:04:05:06 +0100] "POST /form HTTP/2" 302 81', "clf"),
    ("nothing that follows any layout", "custom"),
    ("", "custom"),
    (None, "custom"),
]


def test_formats(spark):
    df = spark.createDataFrame(LINES, "raw string, want string").withColumn("got", detect_format(F.col("raw")))
    assert [r for r in df.collect() if r["got"] != r["want"]] == []


def test_preparse(spark):
    df = spark.createDataFrame(LINES[2:4], "raw string, fmt string").withColumn("fields", preparse(F.col("raw"), F.col("fmt")))
    bsd, cef = (r["fields"] for r in df.collect())
    assert bsd["_app"] == "cron" and bsd["_pid"] == "412" and bsd["hostname"] == "gate2"
    assert cef["src"] == "10.4.5.6" and cef["_severity"] == "4"


def test_coercion(spark):
    row = spark.createDataFrame([('"[10.0.0.1]"', "10.0.0.1:22", "10.0.0.999", "443/tcp", "70000")], "a string, b string, c string, d string, e string")
    got = row.select(*(coerce.ip(F.col(c)) for c in "abc"), *(coerce.port(F.col(c)) for c in "de")).first()
    assert list(got) == ["10.0.0.1", "10.0.0.1", None, 443, None]


def test_brute_force_sequence(spark):
    rows = [(1, 0.0, 1, "f"), (1, 1.0, 2, "f"), (1, 2.0, 3, "f"), (1, 3.0, 4, "s"), (2, 0.0, 5, "f"), (2, 1.0, 6, "s"), (None, 0.0, 7, "f")]
    df = spark.createDataFrame(rows, "k int, t double, o long, e string")
    fail, good = F.col("e") == "f", F.col("e") == "s"
    got = {r["k"]: r["n_alerts"] for r in rules.sequences(df, ["k"], "t", "o", [fail, fail, fail, good], 300.0).collect()}
    assert got == {1: 1, 2: 0}


NAMES = ["format_detect_dist", "coerce_timestamp", "sigma_selection_in", "sequence_brute_force", "template_mask", "log_error_window", "issue_dedup", "relationship_integrity"]


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    import __spark_entry__ as entry

    assert compare(spark, entry.queries()[name], entry.oracle_sql()[name], "/root/testdata/sf0.001") == ""


def test_sequences_hold_no_key_whole(spark):
    """A hot user's events span many batches; nothing gathers them into one row."""
    rows = [(None if i % 50 == 7 else 1 if i % 3 else i % 5, float(i * 7 % 400), i, "ab"[i * i % 7 % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id long, t double, id long, kind string")
    first, last = F.col("kind") == "a", F.col("kind") == "b"
    out = rules.sequences(df, ["user_id"], "t", "id", [first, first, last], 9.0)
    want = {}
    for user in {r[0] for r in rows} - {None}:
        opened, step, start, want[user] = False, 0, 0.0, 0
        for _, t, _, kind in sorted((r for r in rows if r[0] == user), key=lambda r: r[1:3]):
            if opened and t - start > 9:
                step, start = 0, t
            if not opened:
                start = t
            if kind == "aab"[step]:
                opened, step = True, step + 1
                if step == 3:
                    step, start, want[user] = 0, t, want[user] + 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {r["user_id"]: r["n_alerts"] for r in out.collect()} == want and sum(want.values()) > 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in out._jdf.queryExecution().toString()
