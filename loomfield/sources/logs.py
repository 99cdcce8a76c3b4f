"""Log lines: readers, sinks' layouts, and lines rendered from the `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of a rendered event, in SQL that Spark and DuckDB both read.
FIELDS = {
    "user_name": "concat('user', user_id)",
    "src_ip": "concat('10.', user_id % 200, '.', event_id % 250, '.', 1 + user_id % 250)",
    "dst_ip": "concat('192.168.', user_id % 100, '.', 1 + event_id % 200)",
    "src_port": "1024 + event_id % 60000",
    "dst_port": "CASE event_id % 4 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 ELSE 3389 END",
    "host": "concat('host', user_id % 20)",
    "pid": "1000 + event_id % 9000",
    "ok": "event_type NOT IN ('error', 'view')",
    "severity_name": "CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END",
    "bytes": "100 + event_id % 5000",
    "operation": "CASE event_type WHEN 'signup' THEN 'CreateUser' WHEN 'purchase' THEN 'AssumeRole' WHEN 'error' THEN 'DeleteTrail' ELSE 'ConsoleLogin' END",
}
LINE = """CASE event_id % 5
  WHEN 0 THEN concat(bsd, ' ', host, ' sshd[', pid, ']: ', CASE WHEN ok THEN 'Accepted' ELSE 'Failed' END, ' password for ', user_name, ' from ', src_ip, ' port ', src_port, ' ssh2')
  WHEN 1 THEN concat('CEF:0|Acme|Firewall|1.0|', 100 + event_id % 7, '|', event_type, '|', event_id % 11, '|src=', src_ip, ' dst=', dst_ip, ' spt=', src_port, ' dpt=', dst_port, ' act=', event_type)
  WHEN 2 THEN concat('{"eventTime":"', iso, 'Z","eventName":"', operation, '","sourceIPAddress":"', src_ip, '","userName":"', user_name, '","severity":"', severity_name, '","bytes":', bytes, '}')
  WHEN 3 THEN concat('time=', iso, ' user=', user_name, ' action=', event_type, ' src_ip=', src_ip, ' dst_port=', dst_port, ' status=', CASE WHEN ok THEN 'success' ELSE 'failure' END)
  ELSE concat(src_ip, ' - ', user_name, ' [', clf, ' +0000] "GET /item/', event_id % 97, ' HTTP/1.1" ', CASE WHEN ok THEN 200 ELSE 403 END, ' ', bytes) END"""


# Lines that are harder: nested and wide JSON, no known format, tabs in LEEF, values that can't be, too little to say.
ODD_LINE = """CASE event_id % 6
  WHEN 0 THEN concat('{"eventTime":"', iso, 'Z","eventName":"', operation, '","detail":{"user":{"name":"', user_name, '","role":{"id":', event_id % 9, '}},"net":{"from":{"client_ip":"', src_ip, '"}}},"wide":{"a":1,"b":2,"c":3,"d":4,"e":5,"target":"', dst_ip, '"}}')
  WHEN 1 THEN concat('session ', event_id, ' opened for guest from ', src_ip, ' port ', src_port, ' on /run/', pid, ' by daemon')
  WHEN 2 THEN concat('LEEF:1.0|Acme|Edge|2.0|', 200 + event_id % 3, '|src=', src_ip, chr(9), 'msg=login by host=web ok', chr(9), 'username=', user_name)
  WHEN 3 THEN concat(bsd, ' ', host, ' sshd[', pid, ']: Failed password for ', user_name, ' from ', CASE WHEN event_id % 4 = 3 THEN '999.1.1.1' ELSE src_ip END, ' port ', CASE WHEN event_id % 9 = 0 THEN '99999' ELSE CAST(src_port AS STRING) END, ' ssh2')
  WHEN 4 THEN concat('{"eventName":"ConsoleLogin"', CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(',"userName":"', user_name, '"') END, ',"sourceIPAddress":"', CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE src_ip END, '","status":"', event_type, '"}')
  ELSE 'heartbeat ok' END"""


def render_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, ts, raw_log: one of the harder lines for each event."""
    return _rendered(spark, sf_dir, ODD_LINE)


def render_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, ts, raw_log: one line of one of five formats for each event."""
    return _rendered(spark, sf_dir, LINE)


def _rendered(spark: SparkSession, sf_dir: str, line: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    times = {"bsd": F.date_format("ts", "MMM dd HH:mm:ss"), "iso": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "clf": F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")}
    return events.withColumns({k: F.expr(v) for k, v in FIELDS.items()} | times).select(F.col("event_id").alias("log_id"), "ts", F.expr(line).alias("raw_log"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """raw_log of every non-blank line of text files."""
    return spark.read.text(path).select(F.col("value").alias("raw_log")).where(F.length(F.trim("raw_log")) > 0)


# Sources of generated ground truth.
GENERATED = ["synthetic", "contrastive", "fleet_generated"]


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """raw_log, class_uid, class_name, source of real records in JSON lines."""
    return spark.read.schema("raw_log string, class_uid int, class_name string, source string").json(path).where(~F.coalesce(F.col("source"), F.lit("")).isin(GENERATED))


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(all golden entries, the canaries among them: those without a trust score)."""
    schema = "name string, raw_log string, class_uid int, expected map<string,string>, trust_score double, log_format string, skip_reason string"
    golden = spark.read.schema(schema).option("multiLine", True).json(path)
    return golden, golden.where(F.col("trust_score").isNull())


def parse_syslog_wire(value) -> dict:
    """Columns of a syslog datagram: facility, severity, timestamp, hostname, tag, msg."""
    head = r"(?s)^(?:<(\d{1,3})>)?(?:\d )?((?:\w{3} +\d{1,2} \d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}T\S+)? ?)(?:(\S+) )?(?:([^\s:\[]+)(?:\[\d+\])?: )?(.*)$"
    pri = F.expr("try_cast(pri as int)")
    part = lambda k: F.nullif(F.trim(F.regexp_extract(value, head, k)), F.lit(""))
    return {"pri": part(1), "facility": F.shiftright(pri, 3), "severity": pri.bitwiseAND(7), "timestamp": part(2), "hostname": part(3), "tag": part(4), "msg": part(5)}


def write_by_category(events: DataFrame, path: str) -> None:
    """JSON lines in one folder for each category."""
    events.write.mode("append").partitionBy("category").json(path)


def write_by_class_and_day(events: DataFrame, path: str, time: str = "ts") -> None:
    """Parquet by class prefix and UTC day."""
    days = {k: F.date_format(time, f) for k, f in (("yyyy", "yyyy"), ("mm", "MM"), ("dd", "dd"))}
    events.withColumns(days).write.mode("append").partitionBy("class_prefix", "yyyy", "mm", "dd").parquet(path)
