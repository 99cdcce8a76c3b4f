"""Templates, slots and extraction against an ordered reference in plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomfield.functions import coerce
from loomfield.operators import templates as T

LINES = [
    "Jan 5 10:00:01 web1 sshd[411]: Accepted password for amy from 10.0.0.1 port 4022 ssh2",
    "Jan 6 10:00:02 web1 sshd[412]: Failed password for bob from 10.0.0.2 port 4023 ssh2",
    "Jan 6 10:00:09 web1 sshd[413]: Failed password for 1234 from 10.0.0.2 port 4024 ssh2",
    "Jan 6 10:00:09 web1 sshd[413]: Failed password for 1235 from 10.0.0.2 port 4025 ssh2",
    "connection 10.0.0.9:443 -> 10.1.0.7:8080 closed by peer", "connection 10.0.0.8:443 -> 10.1.0.6:8081 closed by peer", "connection 10.0.0.8:444 -> 10.1.0.6:8081 opened by amy",
    'login user="amy" src=10.0.0.1 ok', 'login user="bob" src=10.0.0.2 ok', "login user=x9 src=10.0.0.3 ok", "only once here", "x", "   ", "", None,
    "disk usage at 91 percent on /var/log", "disk usage at 91 percent on /srv/a1", "disk usage at 91 percent on /home",
]


def _entity(spark, tokens):
    rows = spark.createDataFrame([(t,) for t in sorted(set(tokens))], "t string")
    return {r["t"]: r["e"] for r in rows.select("t", coerce.entity(F.col("t")).alias("e")).collect()}


def _reference(spark, lines, similarity=0.4, least=2):
    """Forms in order of first line; each to the most similar template of its leaf."""
    forms = {}
    for k, line in enumerate(lines):
        tokens = (line or "").split()
        if tokens:
            forms.setdefault(tuple("<*>" if re.search("[0-9]", t) else t for t in tokens), []).append((k, tokens))
    leaves = {}
    for form, own in forms.items():
        columns = list(zip(*(t for _, t in own), strict=True))
        tokens = [c[0] if len(set(c)) == 1 else "<*>" for c in columns]
        clusters = leaves.setdefault((len(form), form[0]), [])
        ranked = [(sum(a == b != "<*>" for a, b in zip(c["template"], tokens, strict=True)) / len(form), -c["template"].count("<*>"), -k) for k, c in enumerate(clusters)]
        best = max(ranked, default=None)
        if best is None or best[0] < similarity:
            clusters.append({"template": tokens, "lines": list(own)})
        else:
            c = clusters[-best[2]]
            c["template"] = [a if a == b else "<*>" for a, b in zip(c["template"], tokens, strict=True)]
            c["lines"] += own
    kinds = _entity(spark, [t for line in lines if line for t in line.split()])
    out = {}
    for (_, head), clusters in leaves.items():
        for c in clusters:
            if len(c["lines"]) >= least:
                rows, slots = sorted(c["lines"]), []
                for i, p in enumerate(c["template"]):
                    if p == "<*>":
                        values = [t[i] for _, t in rows]
                        before = next((t.rstrip(":") for t in reversed(c["template"][:i]) if t != "<*>"), "")
                        slots.append((i, Counter(kinds[v] for v in values).most_common(1)[0][0], before, values[:5]))
                out[" ".join(c["template"])] = (head, len(rows), slots)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_clusters_and_slots(spark, parts):
    logs = spark.createDataFrame(list(enumerate(LINES * 2)), "log_id long, raw_log string").repartition(parts)
    got = {r["template"]: (r["head"], r["cluster_size"], [(s["position"], s["entity"], s["before"], s["samples"]) for s in r["slots"]]) for r in T.mine(logs, "log_id").collect()}
    assert got == _reference(spark, LINES * 2)
    assert got["disk usage at 91 percent on <*>"][2] == [(6, "path", "on", ["/var/log", "/srv/a1", "/home", "/var/log", "/srv/a1"])]


def test_extraction(spark):
    logs = spark.createDataFrame(list(enumerate(LINES)), "log_id long, raw_log string")
    more = [(100, "Jan 9 11:11:11 web1 sshd[9]: Accepted password for zoe from 10.9.9.9 port 5000 ssh2"), (101, "disk usage at 50 percent on /x"), (102, None), (103, "")]
    new = spark.createDataFrame(more, "log_id long, raw_log string").withColumn("slots", F.lit("mine"))
    mined = T.mine(logs, "log_id")
    got = {r["log_id"]: r["template_fields"] for r in T.extract(new, mined).collect()}
    assert got[100] == {"metadata.count": "9", "time": "11:11:11", "process.name": "sshd", "user": "zoe", "src_endpoint.ip": "10.9.9.9", "src_endpoint.port": "5000"}
    assert not got[101] and not got[102] and not got[103] and T.extract(new, mined).columns[:3] == new.columns
    own = {r["log_id"]: r["template_fields"] for r in T.extract(logs, mined).collect()}
    assert own[4] == {"src_endpoint.ip": "10.0.0.9", "src_endpoint.port": "443", "dst_endpoint.ip": "10.1.0.7", "dst_endpoint.port": "8080", "user": "closed", "actor.user.name": "peer"}
    assert own[7] == {"user": "amy", "src_endpoint.ip": "10.0.0.1"} and own[10] is None
    assert T.mine(logs.limit(0), "log_id").isEmpty()
