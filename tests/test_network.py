"""Addresses against the standard library, longest networks against brute force, raised issues, columns of maps."""

import ipaddress
from datetime import UTC, datetime, timedelta

import numpy as np
from oracle import compare
from pyspark.sql import functions as F

from loomfield.functions import network
from loomfield.operators import monitors
from loomfield.plans import detection, queries
from loomfield.sources import columns

ODD = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "2001:db8::ff00:42:8329", "2001:DB8:0:0:0:0:0:1", "fe80::1%eth0", "[::1]", "::ffff:10.1.2.3", "64:ff9b::192.0.2.33", "10.0.0.1", '"10.0.0.255"',
       "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", ":1::", "1:::2", "1::2::3", ":::", ":", "", "12345::", "g::1", "1:2:3:4:5:6:7:8::", "10.0.0.256", "1.2.3", "::ffff:10.1.2.300", "1:", ":1", "::1:2:3:4:5:6:7:8", None]


def _key(v):
    try:
        ip = ipaddress.ip_address((v or "").strip("\"'").strip("[]").split("%")[0])
    except ValueError:
        return None
    return f"{int(ip) + (0xFFFF << 32 if ip.version == 4 else 0):032x}"


def test_keys_of_addresses(spark):
    rng = np.random.default_rng(5)
    made = [str(ipaddress.IPv6Address(int.from_bytes(bytes((rng.integers(0, 256, 16) * (rng.random(16) < 0.4)).tolist()), "big"))) for _ in range(300)]
    made += [str(ipaddress.IPv4Address(int(x))) for x in rng.integers(0, 2**32, 100)]
    rows = spark.createDataFrame([(v,) for v in ODD + made], "v string").withColumn("k", network.ip_key(F.col("v")))
    assert [(r["v"], r["k"]) for r in rows.collect() if r["k"] != _key(r["v"])] == []


def test_longest_network(spark):
    nets = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/23", "10.1.3.7", "0.0.0.0/0", "2001:db8::/32", "2001:db8:1::/49", "::/0", "192.168.0.0/27", "bad/8", "10.0.0.0/40", "10.2.0.0/x", None, "10.1.0.0/16"]
    ips = ["10.9.9.9", "10.1.9.9", "10.1.3.8", "10.1.3.7", "8.8.8.8", "2001:db8:1:7fff::1", "2001:db8:1:8000::1", "2001:db8:2::", "fe80::1", "192.168.0.31", "192.168.0.32", "junk", None]
    table = spark.createDataFrame([(n, f"L{k}") for k, n in enumerate(nets)], "cidr string, label string")
    got = network.with_network(spark.createDataFrame([(k, v) for k, v in enumerate(ips * 2)], "id int, ip string"), "ip", table)
    good = [ipaddress.ip_network(n, strict=False) for n in nets if n not in ("bad/8", "10.0.0.0/40", "10.2.0.0/x", None)]
    for r in got.collect():
        try:
            own = [n for n in good if n.version == ipaddress.ip_address(r["ip"] or "").version and ipaddress.ip_address(r["ip"]) in n]
        except ValueError:
            own = []
        assert (r["cidr"] and str(ipaddress.ip_network(r["cidr"]))) == (str(max(own, key=lambda n: n.prefixlen)) if own else None), r
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 26 and "NestedLoop" not in plan and "Cartesian" not in plan


def _users_beyond_a_group(spark, path):
    """Events of users whose numbers take one to eight hexadecimal digits."""
    users = [0, 7, 207, 4_095, 65_535, 65_536, 65_607, 74_565, 1_048_575, 16_777_215, 4_294_967_295]
    rows = [(k, datetime(2026, 1, 1, tzinfo=UTC), users[k % len(users)], "view", 1.0, "{}") for k in range(440)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/made")
    (made,) = (path / "made").glob("*.parquet")
    made.rename(path / "events.parquet")
    return str(path)


def test_ip_keys_of_long_user_numbers(spark, tmp_path):
    assert compare(spark, detection.ip_keys, queries.ORACLE_SQL["ip_keys"], _users_beyond_a_group(spark, tmp_path)) == ""


def test_longest_networks_of_long_user_numbers(spark, tmp_path):
    assert compare(spark, detection.network_longest_prefix, queries.ORACLE_SQL["network_longest_prefix"], _users_beyond_a_group(spark, tmp_path)) == ""


def test_raised_issues(spark):
    start = datetime(2026, 1, 1, tzinfo=UTC)
    hours = [("a", 0), ("a", 23), ("a", 24), ("a", 25), ("a", 48), ("a", 49.5), ("b", 1), (None, 5), (None, 6), ("a", None)]
    rows = [(k, key, start + timedelta(hours=h) if h is not None else None, "x") for k, (key, h) in enumerate(hours)]
    df = spark.createDataFrame(rows, "event_id int, kind string, ts timestamp, `a.b` string").repartition(3)
    got = sorted(r["event_id"] for r in monitors.raised(df, ["kind"], "ts", "event_id", 86_400).collect())
    assert got == [0, 3, 5, 6, 7]  # an event every 23 hours is raised again after a day


def test_columns_of_maps(spark, tmp_path):
    path = str(tmp_path / "t")
    for k, event in enumerate(({"user": "a", "src.ip": "1"}, {"user": "b", "id": "9"})):
        columns.append_columns(spark.createDataFrame([(k, event), (k, {}), (k, None)], "id int, event map<string,string>"), path)
    got = columns.read_columns(spark, path)
    assert set(got.columns) == {"id", "user", "src.ip", "event.id"}
    assert sorted(tuple(r[c] for c in ("id", "user", "src.ip", "event.id")) for r in got.where("user IS NOT NULL").collect()) == [(0, "a", "1", None), (1, "b", None, "9")]
    assert got.count() == 6
