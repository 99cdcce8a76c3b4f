"""Pre-parsers and the pattern library on hostile lines."""

from pyspark.sql import functions as F

from loomfield.operators.library import read_library
from loomfield.operators.normalize import normalize, with_format
from loomfield.operators.preparse import with_fields

LINES = [
    r"Mar  3 10:00:00 gate7 CEF:0|Acme|Wall\|2|1|42|blocked it|7|src=10.0.0.1 msg=Failed login for bob act=deny path=C\=x",
    "LEEF:1.0|Acme|Box|2|E1|src=10.0.0.2\tusrName=Jane Roe\tdevTime=Mar 3 2024",
    '<34>1 2024-03-03T10:00:00Z mx1 app 77 ID9 [a k="v ]"][b x="y"] hello there',
    '{"time":"2024-03-03T10:00:00Z","host":"h1","user":{"name":"amy","geo":{"city":"Bern"}},"big":{"a":1,"b":2,"c":3,"d":4,"e":5,"f":6}}',
    "Mar  3 10:00:00 h2 app[5]: lone words from 10.9.9.9",
]


def test_preparsers(spark):
    rows = with_fields(with_format(spark.createDataFrame(list(enumerate(LINES)), "id int, raw_log string"))).collect()
    got = {r["id"]: r["fields"] for r in rows}
    assert got[0]["msg"] == "Failed login for bob" and got[0]["act"] == "deny" and got[0]["hostname"] == "gate7" and got[0]["path"] == "C=x"
    assert got[1]["usrName"] == "Jane Roe" and got[1]["timestamp"] == "Mar 3 2024"
    assert got[2]["message"] == "hello there" and got[2]["_sd"].endswith('[b x="y"]')
    assert got[3]["user.name"] == "amy" and got[3]["user.geo.city"] == "Bern" and got[3]["big"].startswith("{") and got[3]["hostname"] == "h1"
    assert got[4]["_ips"] == "10.9.9.9" and got[4]["_pid"] == "5"


YAML = r"""
patterns:
  - name: job_done
    match: {log_format: [syslog_bsd], regex: 'jobd\[\d+\]: job (?P<job>\S+) ended with code (?P<code>\d+)'}
    ocsf_class_uid: 1006
    ocsf_class_name: Scheduled Job Activity
    static: {activity_id: 2}
    field_map: {job: job.name, code: status_code}
    severity_map: {field: code, rules: [{range: [0, 0], severity_id: 1}, {range: [1, 255], severity_id: 4}]}
  - name: too_short
    match: {log_format: [syslog_bsd], regex: 'job'}
  - name: bare
    match: {log_format: [syslog_bsd], contains: ended}
    ocsf_class_uid: 6002
  - name: broken
    match: {log_format: [syslog_bsd], regex: 'a(((((((((((((((('}
"""


def test_library_from_yaml(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(YAML)
    (tmp_path / "b.yaml").write_text("{ not yaml")
    library = read_library(str(tmp_path), spark)
    assert [p.name for p in library.patterns] == ["job_done", "bare"]
    logs = [(1, "Mar  3 10:00:00 h jobd[9]: job backup ended with code 3"), (2, "Mar  3 10:00:00 h jobd[9]: job backup ended with code 0"), (3, "Mar  3 10:00:00 h jobd[9]: ended")]
    got = {r["id"]: r for r in normalize(spark.createDataFrame(logs, "id int, raw_log string"), library).select("id", "pattern", "class_uid", "class_name", "severity_id", F.element_at("event", "job.name").alias("job")).collect()}
    assert (got[1]["pattern"], got[1]["class_uid"], got[1]["class_name"], got[1]["severity_id"], got[1]["job"]) == ("job_done", 1006, "Scheduled Job Activity", 4, "backup")
    assert got[2]["severity_id"] == 1 and got[3]["pattern"] is None and got[3]["class_uid"] == 0


def test_what_is_known_before_reaches_the_scan(spark, tmp_path):
    """A filter of raw columns is pushed to the files; lines of other formats, their parsers and patterns aren't touched."""
    from loomfield.operators.normalize import normalize

    path = str(tmp_path / "logs")
    lines = [(1, "Feb  2 04:05:06 h sshd[4]: Failed password for ann from 10.0.0.1 port 22 ssh2"), (2, '{"eventName":"ConsoleLogin","userName":"bob"}'), (2, "Feb  2 04:05:06 h sshd[4]: Accepted password for eve from 10.0.0.2 port 23 ssh2")]
    spark.createDataFrame(lines, "day int, raw_log string").write.parquet(path)
    logs = spark.read.parquet(path)
    some = normalize(logs, where=F.col("day") == 2, formats=["syslog_bsd"])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(day,2)" in plan and "from_json(" not in plan.replace("from_json([", "")
    assert [(r["event"]["user"], r["pattern"]) for r in some.collect()] == [("eve", "sshd_accepted")]
    every = normalize(logs).select("day", "pattern", "event").collect()
    assert sorted((r["day"], r["event"]["user"]) for r in every) == [(1, "ann"), (2, "bob"), (2, "eve")]
