import random


from webcairn.operators import cadence as batch
from webcairn.operators.reports import redact_logs, run_progress
from webcairn.streaming import admission, cadence, pages, progress
from webcairn.streaming.runner import append_to, end_mark, read_sink, run_available, work_dir


def feed(spark, parts, name):
    folder = work_dir(spark, name)
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def last_state(spark, parts, **limits):
    out = work_dir(spark, "t")
    run_available(cadence.cadence_stream(feed(spark, parts, "late"), **limits), append_to(f"{out}/r"), f"{out}/s", "update")
    return cadence.latest_cadence(read_sink(spark, f"{out}/r"))


def test_late_checks_are_folded_in_their_place(spark):
    schema = "site_id string, checked_at bigint, event_id bigint, changed boolean"
    rows = [("a", 20, 2, True), ("a", 10, 1, True)], [("a", 5, 3, False), ("a", 30, 4, True)], [("a", 25, 5, False)]
    parts = [spark.createDataFrame(r, schema) for r in rows]
    want = batch.fold_cadence(spark.createDataFrame([r for x in rows for r in x], schema), "site_id", ["checked_at", "event_id"]).first()
    row = last_state(spark, parts).first()
    assert [row[c] for c in ("checks", "interval_s", "streak", "last_changed_at")] == [want[c] for c in ("checks", "interval_s", "streak", "last_changed_at")]
    assert row["late"] == 0 and row["last_checked_at"] == 30


def test_checks_before_the_kept_time_are_counted(spark):
    schema = "site_id string, checked_at bigint, event_id bigint, changed boolean"
    parts = [spark.createDataFrame(r, schema) for r in ([("a", 20, 2, True), ("a", 10, 1, True)], [("a", 5, 3, False), ("a", 30, 4, True)])]
    row = last_state(spark, parts, keep_s=0).first()
    assert (row["interval_s"], row["streak"], row["checks"], row["late"], row["last_changed_at"]) == (10800, 3, 3, 1, 30)


def test_shuffled_checks_give_the_batch_result(spark):
    rnd = random.Random(8)
    data = [(rnd.choice("ab"), i * 3600, i, rnd.random() < 0.5) for i in range(150)]
    schema = "site_id string, checked_at bigint, event_id bigint, changed boolean"
    want = sorted(map(tuple, batch.fold_cadence(spark.createDataFrame(data, schema), "site_id", ["checked_at", "event_id"]).collect()))
    rnd.shuffle(data)
    parts = [spark.createDataFrame(data[i::3], schema) for i in range(3)]
    got = last_state(spark, parts, keep_s=1_000_000).select("site_id", "checks", "interval_s", "streak", "last_changed_at")
    assert sorted(map(tuple, got.collect())) == want


def test_any_split_gives_the_batch_result(spark):
    rnd = random.Random(4)
    data = [(rnd.choice("abc"), i, i, rnd.random() < 0.5) for i in range(120)]
    schema = "site_id string, checked_at bigint, event_id bigint, changed boolean"
    want = sorted(map(tuple, batch.fold_cadence(spark.createDataFrame(data, schema), "site_id", ["checked_at", "event_id"]).collect()))
    cuts = sorted(rnd.sample(range(1, 119), 2))
    parts = [spark.createDataFrame(x, schema) for x in (data[: cuts[0]], data[cuts[0] : cuts[1]], data[cuts[1] :])]
    out = work_dir(spark, "t")
    run_available(cadence.cadence_stream(feed(spark, parts, "split")), append_to(f"{out}/r"), f"{out}/s", "update")
    got = cadence.latest_cadence(read_sink(spark, f"{out}/r")).select("site_id", "checks", "interval_s", "streak", "last_changed_at")
    assert sorted(map(tuple, got.collect())) == want


def test_keys_share_states(spark):
    """Python is called per bucket, not per key; a key's state is its own and is told only when it has checks."""
    rnd = random.Random(5)
    schema = "site_id string, checked_at bigint, event_id bigint, changed boolean"
    data = [(rnd.choice([str(k) for k in range(60)]), i * 3600, i, rnd.random() < 0.5) for i in range(600)]
    want = sorted(map(str, batch.fold_cadence(spark.createDataFrame(data, schema), "site_id", ["checked_at", "event_id"]).collect()))
    cuts = [data[:500], [r for r in data[500:] if r[0] < "3"], [r for r in data[500:] if r[0] >= "3"]]
    parts = [spark.createDataFrame(x, schema) for x in cuts]
    out = work_dir(spark, "t")
    run_available(cadence.cadence_stream(feed(spark, parts, "shared"), buckets=4), append_to(f"{out}/r"), f"{out}/s", "update")
    sink = read_sink(spark, f"{out}/r")
    got = cadence.latest_cadence(sink).select("site_id", "checks", "interval_s", "streak", "last_changed_at")
    assert sorted(map(str, got.collect())) == want
    told = sorted((r["batch"], r["site_id"]) for r in sink.collect())
    assert told == sorted((k, s) for k, x in enumerate(cuts) for s in {r[0] for r in x})
    assert spark.read.format("statestore").load(f"{out}/s").count() <= 4


def test_progress_ignores_redelivery(spark):
    data = [("r", 1, "/a", "seed"), ("r", 2, "/b", "link"), ("r", 3, "/a", "complete"), ("r", 3, "/a", "complete"), ("r", 0, "/b", "complete")]
    df = spark.createDataFrame(data, "run_id string, event_id bigint, url string, event string")
    want = run_progress(df).first()
    assert (want["found"], want["crawled"], want["drained"]) == (2, 1, False)
    out = work_dir(spark, "t")
    run_available(progress.progress_stream(feed(spark, [df, df], "again")), append_to(f"{out}/r"), f"{out}/s", "update")
    assert progress.progress_from_sink(read_sink(spark, f"{out}/r").drop("batch")).first() == want


def test_a_repeated_batch_publishes_nothing_new(spark):
    out = work_dir(spark, "publish")
    publish = pages.publish_batches(out)
    batches = [spark.createDataFrame(x, "site_id string, run_id string") for x in ([("s", "r1"), ("s", "r1"), ("t", "r2")], [("s", "r1"), ("s", "r3")])]
    for i in (0, 1, 1, 0):
        publish(batches[i], i)
    got = sorted((r["site_id"], r["run_id"], r["version"]) for r in read_sink(spark, out).collect())
    assert got == [("s", "r1", 1), ("s", "r3", 2), ("t", "r2", 1)]


def test_redaction(spark):
    rows = ['{"a":{"apiKey":1,"b":[{"SECRET":{"x":1},"c":"q\\"t"}]},"tokens":[1],"n":null,"f":1.0}', "no json", "[1,{\"body\":2}]", None]
    df = spark.createDataFrame([(x,) for x in rows], "record string")
    got = [r[0] for r in redact_logs(df).collect()]
    assert got[0] == '{"a":{"apiKey":"[redacted]","b":[{"SECRET":"[redacted]","c":"q\\"t"}]},"tokens":"[redacted]","n":null,"f":1.0}'
    assert got[1:] == ["no json", '[1,{"body":"[redacted]"}]', None]
    deep = '{"a":' * 2000 + '{"\\u0061piKey" : {"x":["}",{"y":2}]}, "say":"token: {"}' + "}" * 2000
    odd = ['{"secret":', '{"secret":}', '{"token":tru', ""]
    got = [r[0] for r in redact_logs(spark.createDataFrame([(x,) for x in [deep, *odd]], "record string")).collect()]
    assert got[0] == deep.replace('{"x":["}",{"y":2}]}', '"[redacted]"')
    assert got[1:] == ['{"secret":"[redacted]"', '{"secret":"[redacted]"}', '{"token":"[redacted]"', ""]


def test_end_mark_closes_what_is_open(spark):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    rows = [("a", day), ("a", day), ("b", day + dt.timedelta(minutes=5)), (None, day)]
    df = spark.createDataFrame(rows, "client string, ts timestamp")

    def run(parts):
        out = work_dir(spark, "t")
        run_available(admission.admission_stream(feed(spark, parts, "end"), 60, 1), append_to(f"{out}/r"), f"{out}/s")
        return sorted((r["client"], r["requests"], r["admitted"]) for r in read_sink(spark, f"{out}/r").collect())

    assert run([df]) == [("a", 2, 1)]  # b's window is still open
    assert run([df, end_mark(spark, df.schema)]) == [("a", 2, 1), ("b", 1, 1)]
    events = spark.createDataFrame([("r", "view", day), ("q", "view", day), ("q", "finish", day)], "run_id string, event string, ts timestamp")
    out = work_dir(spark, "t")
    run_available(progress.stale_run_stream(feed(spark, [events, end_mark(spark, events.schema)], "stale")), append_to(f"{out}/r"), f"{out}/s")
    assert [(r["run_id"], r["events"]) for r in read_sink(spark, f"{out}/r").collect()] == [("r", 1)]


def test_progress_state_ends(spark):
    import datetime as dt

    data = [("r", i, f"/{i % 7}", ("seed", "link", "complete")[i * 5 % 3], dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(40)]
    df = spark.createDataFrame(data, "run_id string, event_id bigint, url string, event string, ts timestamp")
    out = work_dir(spark, "t")
    stream = progress.progress_stream(feed(spark, [df.where(f"event_id DIV 10 = {i}") for i in range(4)], "ends"), "2 days")
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}/s").foreachBatch(append_to(f"{out}/r")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] <= 4  # days the watermark has passed are gone
    assert progress.progress_from_sink(read_sink(spark, f"{out}/r").drop("batch")).first() == run_progress(df).first()
