from pyspark.sql import functions as F

from loomfield.operators.detect_format import detect_format
from loomfield.streaming import jobs


def test_formats_match_batch_and_restart_adds_only_new_files(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    (tmp_path / "src").mkdir()
    first = ["CEF:0|Security|IDS|1.0|100|Alert|5|src=192.168.1.1", "", '{"level": "info"}']
    (tmp_path / "src/a.log").write_text("\n".join(first))

    def run():
        query = jobs.write_stream(jobs.with_format(jobs.stream_lines(spark, src)), out, check, ["log_format"])
        query.awaitTermination()
        return sorted((r["raw_log"], r["log_format"]) for r in spark.read.parquet(out).collect())

    batch = spark.createDataFrame([(x,) for x in first if x], "raw_log string").withColumn("f", detect_format(F.col("raw_log")))
    assert run() == sorted(map(tuple, batch.collect()))
    assert len(run()) == 2
    (tmp_path / "src/b.log").write_text("LEEF:1.0|IBM|QRadar|7.0|100|src=192.168.1.1\n")
    assert len(run()) == 3


def test_windows_leave_late_events_out(spark, tmp_path):
    schema, src = "ts timestamp, kind string", tmp_path / "src"
    src.mkdir()

    def run(name, rows):
        (src / name).write_text("\n".join(f'{{"ts": "2026-01-01T{t}Z", "kind": "{k}"}}' for t, k in rows))
        events = spark.readStream.schema(schema).json(str(src))
        jobs.write_stream(jobs.count_windows(events, "ts", ["kind"]), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()

    run("a.json", [("00:00:01", "error"), ("00:04:59", "error"), ("00:05:00", "view")])
    run("b.json", [("01:00:00", "view")])
    run("c.json", [("00:00:02", "error"), ("02:00:00", "view")])
    got = {(r["kind"], r["start"].minute): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).where("start < '2026-01-01 00:30:00'").collect()}
    assert got == {("error", 0): 2, ("view", 5): 1}
