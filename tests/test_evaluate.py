"""The class gate, accuracy with examples, suspected labels, observables and cache scores on small tables."""

from pyspark.sql import functions as F

from loomfield.operators import cache, evaluate


def test_gate_and_back_fill(spark):
    rows = [(3002, "Auth", 0.9), (3002, "Auth", 0.3), (3002, "Auth", 0.29), (None, None, None)]
    df = spark.createDataFrame(rows, "uid int, name string, c double")
    uid, name, sure = evaluate.gated(F.col("uid"), F.col("name"), F.col("c"))
    out = df.select(uid.alias("uid"), name.alias("name"), sure.alias("c"), F.create_map(F.lit("class_uid"), F.lit("4001"), F.lit("class_name"), F.lit("Net")).alias("event"))
    assert [tuple(r)[:3] for r in out.collect()] == [(3002, "Auth", 0.9), (3002, "Auth", 0.3), (0, evaluate.UNSURE, 0.29), (0, evaluate.NO_CLASS, 0.0)]
    after = evaluate.back_filled(F.col("uid"), F.col("name"), F.col("event"))
    assert [tuple(r) for r in out.select(*after).collect()] == [(3002, "Auth"), (3002, "Auth"), (4001, "Net"), (0, evaluate.NO_CLASS)]


def test_accuracy(spark):
    expected = {f"p{k}": str(k) for k in range(6)}
    truth = spark.createDataFrame([(k, expected) for k in range(5)], "id int, expected map<string,string>")
    events = spark.createDataFrame([(0, expected), (1, expected | {"p1": "1.0", "p2": "x"}), (2, {"p0": "0"}), (3, None)], "id int, event map<string,string>")
    pairs = evaluate.compared(events, truth, "id")
    whole, worst = evaluate.accuracy(pairs, top=2)
    assert tuple(whole.first()) == (30, 12, 40.0)
    got = {r["path"]: (r["mismatches"], [tuple(e) for e in r["examples"]]) for r in worst.collect()}
    assert got == {"p2": (4, [("2", None), ("2", "x")]), "p1": (3, [("1", None)])}
    assert sorted(tuple(r) for r in evaluate.suspected_labels(pairs, "id").collect()) == [(2, 5), (3, 6), (4, 6)]
    none = evaluate.accuracy(pairs.limit(0))[0].first()
    assert tuple(none) == (0, 0, 0.0)


def test_scores(spark):
    events = spark.createDataFrame([({"user": "a", "actor.user.name": "a", "src_endpoint.ip": "unknown", "x": "1"},), ({},)], "event map<string,string>")
    assert tuple(evaluate.observables_score(events).first()) == (2, 1, 50.0)
    rows = [(f"f{k}", 1, "n", {}, {}, 10, 10, 0, 0.0, 0.0) for k in range(2)] + [("g", 1, "n", {}, {}, 1, 0, 1, 0.0, 0.0)]
    stats = cache.stats(spark.createDataFrame(rows, cache.COLUMNS), 10, 4)
    one = evaluate.cache_quality(stats).first()
    assert (one["size"], one["promotable"], one["misses"]) == (3, 2, 6) and one["score"] == round(40 * 0.4 + 30 * 0.3 + 30 * 2 / 3, 1)


def test_observable_types(spark):
    """Listed paths, ends of others, excluded ones, repeats of a value by type."""
    from loomfield.operators import rules

    event = {"src_endpoint.ip": "1.1.1.1", "nat.ip": "1.1.1.1", "other.ip": "2.2.2.2", "app.name": "sshd", "metadata.product.name": "x", "query.hostname": "h", "proxy.hostname": "0", "session.uid": "s", "plain": "v", "file.name": "f", "x.user_agent": "ua"}
    row = spark.createDataFrame([(event,), (None,)], "event map<string,string>").select(rules.observables(F.col("event")).alias("o")).collect()
    assert [(o["name"], o["type_id"], o["type"]) for o in row[0]["o"]] == [
        ("app.name", 9, "Process Name"), ("file.name", 7, "File Name"), ("nat.ip", 2, "IP Address"), ("other.ip", 2, "IP Address"), ("query.hostname", 1, "Hostname"), ("session.uid", 10, "Resource UID"), ("x.user_agent", 16, "HTTP User-Agent"),
    ]
    assert not row[1]["o"]
