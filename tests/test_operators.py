"""Operators over turns against row-level oracles written for these tests."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from turnmill.operators import cache, dedup, graph, quality, relevance, session, summary, telemetry
from turnmill.plans import savings
from turnmill.sources import chat
from turnmill.streaming import state, windows

TURNS = "session_id long, turn_id long, role string, content string"
ML = ["What is machine learning?", "It is a field of study.", "What is machine learning?", "As said, a field."]


def turns(spark, *sessions):
    rows = [(s, k, "user" if k % 2 == 0 else "assistant", c) for s, contents in enumerate(sessions) for k, c in enumerate(contents)]
    return spark.createDataFrame(rows, TURNS)


def test_dedup_drops_the_repeat(spark):
    out = dedup.deduplicated(turns(spark, ML, ["only one"], []), "session_id", "turn_id", "content", 0.95).orderBy("session_id", "turn_id").collect()
    assert [r.kept for r in out] == [True, True, False, True, True]
    assert out[2].dedup_similarity == pytest.approx(1)


def test_greedy_is_the_double_loop(spark):
    import random

    random.seed(3)
    pairs = {(a, b): random.random() for a in range(9) for b in range(a + 1, 9)}
    gone = set()
    for a in range(9):
        for b in range(a + 1, 9):
            if a not in gone and pairs[a, b] >= 0.6:
                gone.add(b)
    df = spark.createDataFrame([(1, a, b, s) for (a, b), s in pairs.items()], "block long, a long, b long, similarity double")
    assert {r.row for r in dedup.greedy(df, 0.6).collect()} == gone


def test_pack_skips_and_continues(spark):
    chunks = spark.createDataFrame([(1, 1, "a b c", 0.9), (1, 2, "a b c d e f", 0.8), (1, 3, "a b", 0.7), (1, 4, "a", 0.7)], "q long, c long, t string, score double")
    kept = relevance.packed(chunks, "q", "c", "t", budget=6).where("kept").orderBy("rank").collect()
    assert [r.chunk_id for r in kept] == [1, 3, 4]


def test_split_and_history(spark):
    every = spark.createDataFrame([(1, 0, "system", "Be good."), (1, 1, "user", "What is RLHF?"), (1, 2, "assistant", "RLHF stands for..."), (1, 3, "user", "Give me an example.")], TURNS)
    parts = chat.split(every)
    row = parts.first()
    assert (row.system, row["query"], chat.history(every, parts).count()) == ("Be good.", "Give me an example.", 2)
    assert chat.split(every.where("turn_id < 3"), "last_turn").first()["query"] == ""


@pytest.mark.parametrize(("raw", "expected"), [("plain", "plain"), (None, ""), ('[{"type":"text","text":"a"},{"type":"image_url"},{"type":"text","text":""},{"type":"x","text":"b"}]', "a\n[image]\nb")])
def test_flatten(spark, raw, expected):
    assert spark.createDataFrame([(raw,)], "x string").select(chat.flatten_content(F.col("x")).alias("y")).first()["y"] == expected


def test_logs_and_payloads(spark, tmp_path):
    lines = [{"messages": [{"role": "user", "content": "a"}]}, {"request": {"messages": [{"role": "user", "content": "b"}, {"role": "assistant", "content": "c"}]}}, {"other": 1}]
    (tmp_path / "log.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    assert chat.turns_of(chat.read_log(spark, str(tmp_path / "log.jsonl"))).count() == 3
    made = spark.range(1).select(chat.payload(F.lit("S"), F.lit("so far"), F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content"))), F.lit("q"), F.lit("claude-3"), F.lit(True), F.lit(0.5), F.lit(None).cast("int")).alias("p")).first()["p"]
    body = json.loads(made)
    assert body["max_tokens"] == 4096 and body["system"][0]["cache_control"] == {"type": "ephemeral"} and [m["content"] for m in body["messages"]] == ["[Context summary]\nso far", "Understood.", "x", "q"]
    assert chat.event_stream(spark.createDataFrame([(1, "hi")], "request_id long, text string")).count() == 4


def fold(rows):
    g = graph.Graph()
    for turn, content, named in rows:
        g.add(turn, content, named)
    return g


def test_graph_resolution_and_references(spark):
    g = fold([(0, "see auth_token.py", [("file", "auth_token_file")]), (1, "open that file", []), (2, "it fails", [("symbol", "auth_token_file")])])
    assert {k: n["mention_count"] for k, n in g.nodes.items()} == {("file", "auth_token_file"): 3, ("symbol", "auth_token_file"): 1}
    rows = graph.resolved(turns(spark, ["Look at data_loader.py for task #42", "that file is broken", "it is task #42 again"])).collect()
    by = {(r.etype, r.name): r for r in rows}
    assert by["task", "task_42"].last_seen_turn == 2 and by["file", "data_loader"].mention_count >= 2
    assert graph.resolved(turns(spark)).count() == 0


def test_summaries(spark):
    texts = ["The server failed again today. Why? Restart the server now please. Nothing else matters here at all. The server is a server of servers. One more plain sentence stands here."]
    out = summary.extractive(turns(spark, texts, ["too short"], [None])).orderBy("session_id").collect()
    assert out[0].extract.startswith("The server failed again today. Restart") and out[1].extract == "too short" and out[2].extract == ""
    assert summary.key_points(turns(spark, ["beta alpha beta the and"])).first().summary == "Key points: beta, alpha"
    shrunk = summary.shrunk(turns(spark, ["a b c d", "e f g h", "i j"]).withColumn("summary", F.lit("")), "summary", 8, 3).first()
    assert shrunk.kept_turns == 1


def test_quality_gate(spark):
    df = spark.createDataFrame([("a b c d", "a b c d"), ("a b c d", "a"), ("", None)], "o string, c string")
    out = quality.gated(df, "o", "c").collect()
    assert [r.recommendation for r in out] == ["proceed", "abort_compression", "proceed"] and [r.passed for r in out] == [True, False, True]


def test_plan_adds_up(spark):
    every = turns(spark, ML + ["Tell me about learning machines please"], ["hello there my friend", "hi", "what about cats and dogs"], ["x"])
    for settings in (savings.Settings(), savings.Settings(mode="lossless"), savings.Settings(max_history_tokens=10, keep_recent=1)):
        for r in savings.measured(every, savings.annotated(every, settings), settings).collect():
            assert r.token_savings == r.structural + r.deduplication + r.relevance + r.summarization + r.adjustment and r.post_tokens <= r.raw_tokens
    assert savings.gated(every).count() == 3


def test_plan_keeps_where_entities_of_a_long_query_came_first(spark):
    files = [f"{a}{b}.py" for a in ("alpha", "bravo", "delta") for b in ("Kilo", "Mango", "Tango", "Zulu")]
    filler = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300))
    history = [f"{filler} {files[0]}", "unrelated chatter about weather", f"again {filler} {files[0]} now"]
    every = turns(spark, [*history, "a reply", "Please compare " + ", ".join(files)])
    plan = {r.turn_id: r for r in savings.annotated(every, savings.Settings(dedup_threshold=2.0)).collect()}
    assert plan[0].score < relevance.THRESHOLD and plan[2].score < relevance.THRESHOLD
    # the first turn names one of twelve entities, and first; the third names it again
    assert [plan[k].kept_rel for k in (0, 1, 2)] == [True, False, False]


def test_telemetry(spark):
    facts = spark.createDataFrame([("r", dt.datetime(2024, 1, 1), "e", "gpt-4o", "s", 500, 350, {"structural": 150}, "lossy", 0.9, 1.5, 0.0)], "request_id string, ts timestamp, endpoint string, model string, session_id string, raw_tokens long, post_tokens long, savings_by_stage map<string,long>, compression_mode string, confidence_score double, overhead_ms double, llm_latency_ms double")
    events = telemetry.recorded(facts)
    row = events.first()
    assert (row.token_savings, row.pct_saved) == (150, 30.0)
    assert telemetry.totals(events).first().avg_llm_latency_ms == 0 and telemetry.totals(events.limit(0)).first().min_confidence == 1.0
    assert telemetry.last(events, 0).count() == 1 and telemetry.stage_totals(events).first().tokens_saved == 150


def test_as_of_takes_only_what_came_before(spark):
    at = lambda k: dt.datetime(2024, 1, 1, 0, 0, k)
    signals = spark.createDataFrame([("s", at(5), 1), ("s", at(1), 2), ("t", at(9), 3)], "k string, ts timestamp, id long")
    states = spark.createDataFrame([("s", at(1), "a"), ("s", at(4), "b"), ("s", at(5), "c")], "k string, ts timestamp, v string")
    assert {r.id: r.last_v for r in telemetry.as_of(signals, states, "k", "ts", ("v",)).collect()} == {1: "b", 2: None, 3: None}


LOG = [("a", 0, 1), ("a", 100, 2), ("a", 299, 3), ("a", 301, 4), ("b", 5, 5), ("a", 700, 6)]


def test_cache(spark):
    log = spark.createDataFrame([(k, dt.datetime.fromtimestamp(t, dt.UTC), i) for k, t, i in LOG], "key string, ts timestamp, i long")
    hits = {r.i: r.hit for r in cache.lookups(log, "key", "ts", 300, "i").collect()}
    assert hits == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False}
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    entries = spark.createDataFrame([("graph:u:1", "x", dt.datetime(2024, 1, 1, 0, 9, tzinfo=dt.UTC)), ("graph:u:2", "y", dt.datetime(2024, 1, 1, 0, 11, tzinfo=dt.UTC))], "key string, value string, expires_at timestamp")
    assert cache.swept(entries, now).count() == 1
    assert cache.put(entries, spark.createDataFrame([("graph:u:2", "z")], "key string, value string"), now, 60).where("value = 'z'").count() == 1
    assert cache.get(entries, entries.select("key"), now).where("hit").count() == 1
    assert [r.key for r in cache.invalidated(entries, spark.createDataFrame([(1,)], "session_id long")).collect()] == ["graph:u:2"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_groups_are_walked_a_row_at_a_time(spark):
    import random

    rng = random.Random(4)
    # one key beyond an Arrow batch, few of the others, and a null key
    log = [(k, rng.randrange(40_000), i) for i, k in enumerate(["hot"] * 25_000 + ["a"] * 50 + [None] * 50)]
    made = cache.lookups(spark.createDataFrame([(k, dt.datetime.fromtimestamp(t, dt.UTC), i) for k, t, i in log], "key string, ts timestamp, i long").repartition(5), "key", "ts", 300, "i")
    wanted, until = {}, {}
    for k, t, i in sorted(log, key=lambda x: x[1:]):
        wanted[i] = t <= until.get(k, -1)
        until[k] = until[k] if wanted[i] else t + 300
    assert {r.i: r.hit for r in made.collect()} == wanted and made.columns == ["key", "ts", "i", "hit"]
    chunks = [(k, i, "w " * (n := rng.choice([0, 1, 5, 300])), rng.randrange(50) / 50, n) for i, (k, *_) in enumerate(log)]
    packed = relevance.packed(spark.createDataFrame(chunks, "q string, c long, t string, score double, n long").repartition(5), "q", "c", "t", budget=900)
    expected, rank, used = {}, {}, {}
    for k, i, _, _, n in sorted(chunks, key=lambda x: (-x[3], x[1])):
        rank[k] = rank.get(k, 0) + 1
        fits = used.get(k, 0) + n <= 900
        used[k] = used.get(k, 0) + n * fits
        expected[i] = (rank[k], n, fits)
    assert {r.chunk_id: (r["rank"], r.tokens, r.kept) for r in packed.collect()} == expected
    assert not any("collect_list" in _plan(df) for df in (made, packed))


@pytest.mark.parametrize("kind", ["double", "long"])
def test_ranks_of_a_group_without_its_list(spark, kind):
    import math
    import random
    import statistics

    rng = random.Random(9)
    number = (lambda: rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 1e200, 0.0, -0.0, 1e-300, 7.5])) if kind == "double" else (lambda: rng.choice([rng.randrange(-5, 5), rng.randrange(-(2**62), 2**62)]))
    groups = {"a": [number() for _ in range(3001)], "b": [number() for _ in range(40)], None: [number()], "d": [number(), number()]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None)]
    made = telemetry.latency(spark.createDataFrame(rows, f"g string, v {kind}").repartition(4), "g", "v")
    found = {r.g: r for r in made.collect()}
    assert set(found) == {*groups, "none"} and found["none"].p95_ms is None and found["none"].median_ms is None
    for g, vs in groups.items():
        assert (found[g].n, found[g].p95_ms) == (len(vs), sorted(vs)[max(1, math.floor(len(vs) * 0.95)) - 1])
        assert found[g].median_ms == pytest.approx(statistics.median(vs))
    assert made.columns == ["g", "n", "min_ms", "mean_ms", "median_ms", "max_ms", "stdev_ms", "p95_ms"]
    by_shuffle = telemetry.latency(spark.createDataFrame(rows, f"g string, v {kind}").repartition(4), "g", "v", most_broadcast=0)
    assert {r.g: (r.n, r.median_ms, r.p95_ms) for r in by_shuffle.collect()} == {g: (r.n, r.median_ms, r.p95_ms) for g, r in found.items()}
    assert not any(x in _plan(made) for x in ("collect_list", "median(", "percentile("))


def test_latency_in_two_passes(spark, monkeypatch):
    import math
    import random

    rng = random.Random(4)
    groups = {"a": [rng.gauss(0, 9) for _ in range(3001)], "ties": [rng.choice([1.0, 2.0, 2.5]) for _ in range(900)], "few": [3.0, float("nan"), 1.0], "b": [float(k) for k in range(201)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    nulls = [("nulls", v) for v in [float(k) for k in range(300)] + [None] * 200]
    rounds, by_rounds = [], telemetry.at_ranks
    monkeypatch.setattr(telemetry, "at_ranks", lambda *a, **k: rounds.append(a) or by_rounds(*a, **k))
    last = lambda vs: sorted(vs, key=lambda v: (math.isnan(v), v))
    table = lambda r: spark.createDataFrame(r, "g string, v double").repartition(4)
    for most_broadcast in (100, 0):
        found = {r.g: r for r in telemetry.latency(table(rows), "g", "v", most_broadcast, accuracy=100).collect()}
        for g, vs in groups.items():
            n, ordered = len(vs), last(vs)
            assert found[g].p95_ms == ordered[max(1, math.floor(n * 0.95)) - 1]
            assert found[g].median_ms == pytest.approx((ordered[(n - 1) // 2] + ordered[n // 2]) / 2)
    assert not rounds  # the sketch's bounds held for every place
    found = {r.g: r for r in telemetry.latency(table(rows + nulls), "g", "v", accuracy=100, most_values=1000).collect()}
    assert len(rounds) == 1 and {(r.g, r.which) for r in rounds[0][3].collect()} == {("a", "p95"), ("a", "low"), ("a", "high")}
    assert found["a"].p95_ms == last(groups["a"])[math.floor(3001 * 0.95) - 1] and found["a"].median_ms == last(groups["a"])[1500]
    assert (found["nulls"].n, found["nulls"].median_ms, found["nulls"].p95_ms) == (500, 149.5, None)  # the 475th of 300 values
    some = [("some", float(k)) for k in range(300)] + [("some", None)] * 10
    assert telemetry.latency(table(some), "g", "v", accuracy=100).first().p95_ms == 293.0 and len(rounds) == 2


def _run(stream, path, mode="update"):
    rows = []
    # with timers or a time to live a stream goes on with empty batches for ever, and so it would never end
    stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).foreachBatch(lambda df, _: rows.extend(df.collect())).start()
    try:
        assert q.awaitTermination(240), "the stream did not end"
    finally:
        q.stop()
    return rows


def test_streams_agree_with_batch(spark, tmp_path):
    every = turns(spark, ["Look at data_loader.py for task #42", "that file is broken", "it is task #42 again"], ["plain words"])
    every.write.parquet(str(tmp_path / "turns"))
    rows = _run(state.graph_stream(spark.readStream.schema(every.schema).parquet(str(tmp_path / "turns"))), tmp_path / "c1")
    batch = graph.resolved(every).groupBy("session_id").agg(F.count("*").alias("n"), F.sum("mention_count").alias("m")).collect()
    assert {(r.session_id, r.entities, r.mentions) for r in rows if r.entities} == {(str(r.session_id), r.n, r.m) for r in batch}
    log = spark.createDataFrame([(k, i, float(t)) for k, t, i in LOG], "key string, id long, t double")
    log.write.parquet(str(tmp_path / "log"))
    hits = _run(state.cache_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), 300), tmp_path / "c2")
    assert {r.id: r.hit for r in hits} == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_windows_stream_and_batch(spark, tmp_path):
    events = spark.createDataFrame([(dt.datetime(2024, 1, d, h), "view", 1.5) for d in (1, 2) for h in (1, 5)], "ts timestamp_ntz, event_type string, value double")
    events.write.parquet(str(tmp_path / "e"))
    batch = windows.tumbling(events, "1 day", "event_type", "value").collect()
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "1 day", "event_type", "value", late="1 hour")
    assert sorted(_run(stream, tmp_path / "c", "complete")) == sorted(batch) and len(batch) == 2
    assert windows.sessions(events.withColumn("user_id", F.lit(1)), "2 hours", "user_id").count() == 4


def test_resolution_is_the_plain_fold(spark):
    """Entities of many turns against a fold written with lists and linear search."""
    import random

    rng = random.Random(7)
    pieces = ["data_loader.py", "loader_data.py", "AuthService", "auth_token_store", "that file", "this function", "it", "task #7", "parse_rows(", "see https://a.io/q", "plain words", "this class", "MAX_ROWS"]
    texts = [[" ".join(rng.choices(pieces, k=rng.randrange(5))) for _ in range(12)] for _ in range(6)]
    for s, row in enumerate(texts):
        nodes = []  # [etype, name, first, last, count, aliases, parts]
        for turn, content in enumerate(row):
            from turnmill.functions import sqlfuncs

            said = [(t, n) for t, n, _ in sqlfuncs.found_entities(content)]
            for etype, pattern in graph._REFERENCES:
                of = [x for x in nodes if etype in (None, x[0])]
                if pattern.search(content) and of:
                    newest = max(x[3] for x in of)
                    target = next(x for x in of if x[3] == newest)
                    use = etype or next(x[0] for x in nodes if x[1] == target[1])
                    if (use, target[1]) not in said:
                        said.append((use, target[1]))
            kinds = list(dict.fromkeys(t for t, _ in said))
            for etype, name in sorted(said, key=lambda m: kinds.index(m[0])):
                own, best, most = set(graph.name_parts(name)), name, 0.0
                for x in nodes if own else []:
                    share = len(own & x[6]) / max(len(own), len(x[6]), 1)
                    if share >= 0.7 and share > most:
                        best, most = x[1], share
                known = next((x for x in nodes if (x[0], x[1]) == (etype, best)), None)
                if known is None:
                    nodes.append([etype, best, turn, turn, 1, [name] if name != best else [], set(graph.name_parts(best)) | own])
                else:
                    known[3], known[4] = turn, known[4] + 1
                    if name != best and name not in known[5]:
                        known[5].append(name)
                        known[6] |= own
        texts[s] = (row, sorted((*x[:5], tuple(x[5])) for x in nodes))
    made = graph.resolved(turns(spark, *[row for row, _ in texts]))
    found = {}
    for r in made.collect():
        found.setdefault(r.session_id, []).append((r.etype, r.name, r.first_seen_turn, r.last_seen_turn, r.mention_count, tuple(r.aliases)))
    assert {s: sorted(v) for s, v in found.items()} == {s: wanted for s, (_, wanted) in enumerate(texts) if wanted}
    again = graph.reloaded(graph.serialised(made)).select(*made.columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, made.collect()))
    partial = spark.createDataFrame([("s", '{"entities":[{"name":"a","etype":"file"}]}'), ("t", "{}"), ("u", None)], "session_id string, graph string")
    assert [tuple(r) for r in graph.reloaded(partial).collect()] == [("s", "file", "a", 0, 0, 1, [])]


def test_a_hot_session_is_decided_link_by_link(spark):
    """One block of many equal rows: all but the first go, and no list of links is held."""
    rows = spark.createDataFrame([(0, k, f"the same words again {k % 2}") for k in range(600)] + [(1, 0, "other")], TURNS.replace("role string, ", ""))
    out = dedup.deduplicated(rows, "session_id", "turn_id", "content", 0.99)
    assert {(r.session_id, r.turn_id) for r in out.where("kept").collect()} == {(0, 0), (0, 1), (1, 0)} and out.count() == 601


def test_gate_and_loss_logs(spark):
    verdicts = quality.gated(spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "a b c d", "a")], "session_id long, o string, c string"), "o", "c")
    assert [(r.session_id, r.threshold, r.mode_after) for r in telemetry.gate_log(verdicts, 0.15).collect()] == [(2, 0.15, "lossless")]
    signals = spark.createDataFrame([(5, "s", 3), (6, "s", None)], "request_id long, session_id string, last_request_id long")
    details = spark.createDataFrame([(3, "relevance", 4, "b"), (3, "deduplication", 1, "a"), (3, "relevance", 2, "a")], "request_id long, stage string, removed_index long, entity string")
    rows = {r.request_id: r for r in telemetry.loss_log(signals, details).collect()}
    assert (rows[5].stages, rows[5].removed_indices, rows[5].entities) == (["deduplication", "relevance"], [1, 2, 4], ["a", "b"]) and rows[6].stages is None


def test_last_compression_stream(spark, tmp_path):
    rows = [("s", 1, 1.0, None), ("s", 2, 2.0, "x"), ("s", 3, 3.0, None), ("s", 4, 4.0, "y"), ("s", 5, 5.0, None), ("t", 6, 1.0, None)]
    table = spark.createDataFrame(rows, "session_id string, id long, t double, details string")
    table.write.parquet(str(tmp_path / "d"))
    out = _run(state.last_compression_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "d"))), tmp_path / "c3")
    assert {(r.id, r.last_id, r.details) for r in out} == {(1, None, None), (3, 2, "x"), (5, 4, "y"), (6, None, None)}


def test_summary_stream(spark, tmp_path):
    table = spark.createDataFrame([("s", 1, "one"), ("s", 2, "two"), ("t", 1, "x" * 20)], "session_id string, turn_id long, extract string")
    table.write.parquet(str(tmp_path / "d"))
    out = _run(state.summary_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "d")), 10), tmp_path / "c4")
    assert {(r.session_id, r.summary) for r in out} == {("s", "one | two"), ("t", "x" * 10)}


def test_bounded_sink_and_reports(spark, tmp_path):
    keep = windows.bounded(3, str(tmp_path / "log"))
    make = lambda ids: spark.createDataFrame([(k, dt.datetime(2024, 1, 1, 0, 0, k)) for k in ids], "request_id long, ts timestamp")
    keep(make([1, 2]), 0)
    keep(make([3, 4, 5]), 1)
    assert sorted(r.request_id for r in spark.read.parquet(str(tmp_path / "log/v=1")).collect()) == [3, 4, 5]
    chat.write_report(make([1]), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1
    (tmp_path / "requests.jsonl").write_text(json.dumps({"model": "gpt-4o", "messages": [{"role": "user", "content": "hi"}], "session_id": "s"}) + "\n")
    assert chat.read_requests(spark, str(tmp_path / "requests.jsonl")).first().messages[0].content == "hi"


def test_high_water_mark_counts_each_event_once(spark):
    e = spark.createDataFrame([(dt.datetime(2024, 1, d, h), 1.0) for d in (1, 2) for h in (1, 2, 3)], "ts timestamp, cost_usd_saved double")
    part = telemetry.rolled_up_since(e.where("hour(ts) <= 2"))
    assert sorted((r.day, r.requests) for r in telemetry.rolled_up_since(e, part).collect()) == [("2024-01-01", 3), ("2024-01-02", 3)]


def _ranges(spark, n=40):
    """Many ranges for few rows, so a hot key spans several of them."""
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    _ranges(spark)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_hot_key_of_lookups_is_folded_in_ranges(spark, many_ranges):
    import random

    rng = random.Random(2)
    logs = {
        "hot": sorted(rng.uniform(0, 4000) for _ in range(2500)), "even": [k * 7.0 for k in range(900)], "bursts": [float(k // 9 * 50) for k in range(400)],
        "one": [5.0], "gap": [0.0, 1e6, 1e6 + 1], "other": sorted(rng.uniform(0, 1e5) for _ in range(60)),
    }
    rows = [(k, t, n) for k, ts in logs.items() for n, t in enumerate(ts)] + [("hot", None, -1), ("nulls", None, 0), (None, 3.0, 0), (None, 4.0, 1)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "key string, t double, id long").withColumn("ts", F.col("t").cast("timestamp"))
    for ttl in (300, 20, 0):
        made = cache.lookups(log, "key", "ts", ttl, tie="id")
        found = {(r.key, r.id): r.hit for r in made.collect()}
        wanted = {("nulls", 0): False, ("hot", -1): False}
        for key, times in [*logs.items(), (None, [3.0, 4.0])]:
            until = -1.0
            for n, t in enumerate(times):
                t = round(t, 6)
                wanted[key, n] = t <= until
                until = until if t <= until else t + ttl
        assert {k for k in wanted if found[k] != wanted[k]} == set() and found.keys() == wanted.keys()


def test_a_hot_query_is_packed_in_ranges(spark, many_ranges):
    import random

    rng = random.Random(6)
    rows = [("hot", k, "w " * rng.choice([0, 1, 2, 3, 30, 70, 400]), round(rng.random(), 2)) for k in range(3000)] + [(q, k, "w " * rng.randrange(60), round(rng.random(), 1)) for q in "abc" for k in range(40)] + [("hot", 9001, None, 0.5)]
    chunks = spark.createDataFrame(rows, "q string, c long, t string, score double")
    for budget in (50, 1000, 60_000):
        found = {(r.query_id, r.chunk_id): (r.rank, r.kept) for r in relevance.packed(chunks, "q", "c", "t", budget).collect()}
        wanted = {}
        for q in ("hot", "a", "b", "c"):
            used = 0
            for rank, (_, c, t, _s) in enumerate(sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1])), 1):
                size = len((t or "").split())
                fits = used + size <= budget
                used += size if fits else 0
                wanted[q, c] = (rank, fits)
        assert found == wanted


def test_transitions_are_the_walk():
    import random

    rng = random.Random(1)
    for _ in range(200):
        ttl = rng.choice([0, 3, 20])
        times = sorted(rng.choice([rng.uniform(0, 60), float(rng.randrange(60))]) for _ in range(rng.randrange(40)))
        fold = cache.Expiry(ttl)
        over = fold.transition()
        for t in times:
            over.add(t)
        for until in (float("-inf"), *(rng.uniform(-5, (times[0] if times else 0) + ttl) for _ in range(20)), *times[:3]):
            if not times or until <= times[0] + ttl:
                state = until
                for t in times:
                    state, _ = fold.move(state, t)
                assert over.of(until) == state


def test_large_blocks_are_the_double_loop(spark):
    """Blocks over the limit against all pairs: near copies, repeats, empty rows, shared words."""
    import math
    import random
    import re
    from collections import Counter

    rng = random.Random(21)
    vocabulary = [f"w{int(rng.paretovariate(0.8))}" for _ in range(400)] + [f"v{k}" for k in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randrange(3, 14))) for _ in range(40)]

    def text():
        kind = rng.randrange(5)
        words = rng.choice(base).split()
        if kind < 2:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if kind == 2:
            rng.shuffle(words)
        return " ".join(rng.choices(vocabulary, k=9)) if kind == 4 else " ".join(words)

    sizes = {0: 180, 1: 90, 2: 5, 3: 1}
    rows = [(b, k, rng.choice(["", None, "--"]) if rng.random() < 0.05 else text()) for b, n in sizes.items() for k in range(n)]
    table = spark.createDataFrame(rows, "session_id long, turn_id long, content string").repartition(4)
    for threshold in (0.92, 0.6):
        wanted = {}
        for b in sizes:
            texts = [re.findall(r"[a-z0-9']+", (t or "").lower()) for s, _, t in rows if s == b]
            df = Counter(w for t in texts for w in set(t))
            vectors = []
            for t in texts:
                v = {w: c / len(t) * (math.log((len(texts) + 1) / (df[w] + 1)) + 1) for w, c in Counter(t).items()}
                size = math.sqrt(sum(x * x for x in v.values()))
                vectors.append({w: x / size for w, x in v.items()})
            kept = []
            for k, v in enumerate(vectors):
                by = next((s for j in kept if (s := sum(x * vectors[j].get(w, 0.0) for w, x in v.items())) >= threshold), None)
                wanted[b, k] = by
                if by is None:
                    kept.append(k)
        found = {(r.session_id, r.turn_id): r.dedup_similarity for r in dedup.deduplicated(table, "session_id", "turn_id", "content", threshold, dedup.large(table, "session_id", 50)).collect()}
        assert found.keys() == wanted.keys()
        assert {k for k, s in wanted.items() if s is not None} == {k for k, s in found.items() if s is not None}
        assert all(s is None or found[k] == pytest.approx(s, abs=1e-9) for k, s in wanted.items())
    assert dedup.large(table.limit(0), "session_id") is None


@pytest.mark.parametrize("terms", [1_000_000, 500])
def test_large_blocks_in_chunks(spark, monkeypatch, terms):
    """Pairs and greedy removal of blocks in one chunk or many; pairs that only share a listed term never become rows."""
    import random
    import re

    from turnmill.operators import largeblocks

    monkeypatch.setattr(largeblocks, "CHUNK", terms)
    rng = random.Random(5)
    base = [[f"r{k}" for k in rng.sample(range(30), 4)] + [f"c{k}" for k in rng.sample(range(12), 4)] for _ in range(120)]
    texts = base + [[*b[:-1], "c99"] for b in base[:30]] + [list(reversed(b)) for b in base[:10]] + [[]]
    rows = spark.createDataFrame([("x", k, " ".join(t)) for k, t in enumerate(texts)] + [("y", k, "same words here") for k in range(9)] + [(None, 0, "same"), (None, 1, "same")], "session_id string, turn_id long, content string")
    found = largeblocks.pairs(rows, "session_id", "turn_id", "content", 0.8)
    near = {(r.block, r.a, r.b): r.similarity for r in found.collect()}
    every = {(r.block, r.a, r.b): r.similarity for r in dedup.tfidf_pairs(dedup.tfidf(rows, "session_id", "turn_id", "content"), 0.8).where("block is not null").collect()}
    assert near == pytest.approx(every, abs=1e-9) and len(near) > 60
    assert not re.search(r"row#\d+L? < row#\d+L?", found._jdf.queryExecution().executedPlan().toString())
    wanted, held = {}, []
    for block, k in [("x", k) for k in range(len(texts))] + [("y", k) for k in range(9)]:
        wanted[block, k] = not any((block, j, k) in every for b, j in held if b == block)
        held += [(block, k)] * wanted[block, k]
    marked = dedup.deduplicated(rows.where("session_id is not null"), "session_id", "turn_id", "content", 0.8, dedup.large(rows, "session_id", 5))
    assert {(r.session_id, r.turn_id): r.kept for r in marked.collect()} == wanted


def test_candidates_meet_where_both_are_long_enough(monkeypatch):
    """Candidates hold all pairs that reach the threshold, and fewer than share a listed term; rows multiplied together or pair by pair, and marked left and right, give the same."""
    import numpy as np
    import pyarrow as pa

    from turnmill.operators import largeblocks

    rng, least = np.random.default_rng(3), 0.7
    weight = rng.pareto(1.5, (90, 400)) * (rng.random((90, 400)) < 0.08)
    weight[:40, 399] += 10 + 30 * rng.random(40)  # one term that many rows are about
    weight[:, 398] += 0.1
    rows = rng.permutation(90) * 7
    by = np.lexsort((np.arange(400), (weight > 0).sum(0)))

    def chunk(at, left=None):
        terms = [[int(t) for t in by if weight[k, t]] for k in at]
        flags = [np.ones(len(at), bool), np.ones(len(at), bool)] if left is None else [left[at], ~left[at]]
        held = [pa.array([[weight[k, t] for t in ts] for k, ts in zip(at, terms, strict=True)])]
        return largeblocks.chunk(pa.table([pa.array(rows[at]), pa.array(terms), *held, *map(pa.array, flags)], ["row", "terms", "weight", "left", "right"]), least)

    unit = weight / np.sqrt((weight**2).sum(1))[:, None]
    reach = {(int(min(rows[i], rows[j])), int(max(rows[i], rows[j]))): unit[i] @ unit[j] for i in range(90) for j in range(i) if unit[i] @ unit[j] >= least}
    a, b, left = np.arange(0, 90, 2), np.arange(1, 90, 2), rng.random(90) < 0.4
    left_rows = set(rows[left].tolist())
    for group in (1, 4, 1000):
        monkeypatch.setattr(largeblocks, "GROUP", group)
        for cells in (10, 2_000_000):
            monkeypatch.setattr(largeblocks, "CELLS", cells)
            for flags in (None, left):
                x, y = chunk(a, flags), chunk(b, flags)
                found = {(int(p), int(q)): s for one, other in ((x, x), (x, y), (y, y)) for ps, qs, ss in largeblocks._pairs(one, other, least) for p, q, s in zip(ps, qs, ss, strict=True)}
                assert found == pytest.approx({k: s for k, s in reach.items() if flags is None or (k[0] in left_rows and k[1] not in left_rows)}, abs=1e-9) and len(found) > 30
    x, y = chunk(a), chunk(b)
    place = {int(t): k for k, t in enumerate(y.terms)}
    there = np.array([place.get(int(t), -1) for t in x.terms])
    offered = {(i, j) for p, q in largeblocks.candidates(x, y, there, least, x.left, y.left) for i, j in zip(p.tolist(), q.tolist(), strict=True)}
    listed = lambda c, r: {int(c.terms[c.code[e]]) for e in c.listed if c.begin[r] <= e < c.begin[r + 1]}
    shared = {(i, j) for i in range(45) for j in range(45) if listed(x, i) & listed(y, j)}
    assert {(i, j) for i in range(45) for j in range(45) if tuple(sorted((int(x.rows[i]), int(y.rows[j])))) in reach} <= offered < shared


def test_few_large_blocks_spread_over_tasks(spark):
    """A block's classes stand in many tasks, whatever Spark takes the table of large blocks for."""
    from turnmill.operators import largeblocks

    rows = spark.range(600).selectExpr("if(id < 0, 'y', 'x') AS block", "id AS row", "concat('a', id % 97, ' b', id % 89, ' c', id) AS text")
    found = dedup.deduplicated(rows, "block", "row", "text", 0.9, dedup.large(rows, "block", 300))
    assert found.where("kept").count() == 600
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        _, classes = largeblocks.classes(rows.join(dedup.large(rows, "block", 300).select("block"), "block", "left_semi"), "block", "row", "text")
        assert classes.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        for k in held:
            spark.conf.unset(k)


@pytest.mark.parametrize("least_rows", [1024, 8])
def test_dense_pairs_in_chunks(spark, monkeypatch, least_rows):
    """All pairs of blocks in one chunk or many, odd vectors too, without a join of rows."""
    import random
    import re

    monkeypatch.setattr(dedup, "LEAST_ROWS", least_rows)
    rng = random.Random(9)
    rows = [(b, k, [rng.gauss(0, 1) for _ in range(5)]) for b, n in (("x", 40), ("y", 6), (None, 3)) for k in range(n)]
    rows += [("x", 100, None), ("x", 101, [0.0] * 5), ("x", 102, [1.0, 2.0]), ("x", 103, [1.0, None, 2.0, 0.0, 0.0]), ("x", 104, []), ("x", 105, [2.0, 4.0]), ("y", 5, [1.0] * 5)]
    wanted = []
    for i, (b, k, v) in enumerate(rows):
        for c, m, w in rows[i + 1 :]:
            if b is not None and b == c and k < m:
                fits = v and w and len(v) == len(w) and None not in v and None not in w
                size = sum(x * x for x in v) ** 0.5 * sum(x * x for x in w) ** 0.5 if fits else 0
                wanted.append((b, k, m, round(sum(x * y for x, y in zip(v, w, strict=True)) / size, 6) if size else 0.0))
    table = spark.createDataFrame(rows, "block string, row long, v array<double>").repartition(3)
    found = dedup.dense_pairs(table, "block", "row", "v", digits=6)
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)
    assert not re.search(r"row#\d+L? < row#\d+L?", found._jdf.queryExecution().executedPlan().toString())
    assert sorted(tuple(r)[:3] for r in dedup.dense_pairs(table, "block", "row", "v", 0.5).collect()) == sorted(r[:3] for r in wanted if r[3] >= 0.5)


def test_dense_vectors_stay_as_they_are_stored():
    """A chunk of floats takes four bytes a value; cosines are those of doubles all the same."""
    import numpy as np
    import pyarrow as pa

    values = np.random.default_rng(2).normal(size=(30, 16)).astype(np.float32)
    chunk = lambda kind: dedup._vectors(pa.table({"row": pa.array(range(30)), "v": pa.array(values.tolist(), pa.list_(kind))}))
    few, many = chunk(pa.float32()), chunk(pa.float64())
    assert few[1].dtype == np.float32 and few[1].nbytes * 2 == many[1].nbytes
    for one, other in zip(dedup._cosines(few, few, None, None), dedup._cosines(many, many, None, None), strict=True):
        assert all(np.array_equal(p, q) for p, q in zip(one, other, strict=True))


def test_references_are_sought_where_something_is_named(monkeypatch):
    """A text isn't searched for a reference to a type of which nothing is named yet."""
    sought = []

    class Watched:
        def __init__(self, etype):
            self.etype = etype

        def search(self, content):
            sought.append(self.etype)
            return self.etype in content if self.etype else False

    monkeypatch.setattr(graph, "_REFERENCES", [(t, Watched(t)) for t in ("file", "task", None)])
    made = graph.Graph()
    made.add(0, "that file", [])
    assert sought == []
    made.add(1, "x", [("file", "auth")])
    made.add(2, "that file", [])
    assert sought == ["file", None] and made.nodes["file", "auth"]["last_seen_turn"] == 2


def _chat(messages, recent, most):
    """What each user message's prompt holds, from whole lists of messages."""
    import re
    from collections import Counter

    def context(summary, prior, n):
        last = prior[-n:] if n > 0 else []
        lines = ([f"Summary: {summary}"] if summary else []) + (["Recent:", *(f"User: {m}" for m in last)] if last else [])
        return "\n".join(lines)

    def told(older):
        text = " ".join(m for m in older if m)
        words = Counter(w for w in re.findall(r"\b[a-zA-Z]{3,}\b", text.lower()) if w not in summary.KEY_POINT_STOPS)
        top = [w for w, _ in words.most_common(12)]
        return ("Key points: " + ", ".join(top) if top else text)[:600]

    now, prior, out = "", [], []
    for m in messages:
        said = context(now, prior, recent)
        if len(said.split()) > most:
            older = prior[:-recent] if recent > 0 else prior
            now = f"{now} {told(older)}".strip() if now else told(older)
            prior = prior[-recent:] if recent > 0 else []
            said = context(now, prior, recent)
        n = max(0, recent - 1)
        while n > 0 and len(said.split()) > most:
            said = context(now, prior, n)
            n -= 1
        out.append((said, len(said.split()), now, len(prior) + 1))
        prior = [*prior, m]
    return out


def test_chat_sessions_batch_and_stream(spark, tmp_path):
    import random

    rng = random.Random(31)
    words = ["deploy", "Server", "the", "x", "café", "naïve", "cache", "miss", "42", "disk", "what", "retry"]
    talks = {s: [" ".join(rng.choices(words, k=rng.randrange(9))) for _ in range(14)] for s in range(5)} | {9: ["1 2", "3"] * 9}
    rows = [(s, k, role, m) for s, ms in talks.items() for k, m in enumerate(ms) for role in (["user"] if k % 5 else ["user", "assistant"])]
    table = spark.createDataFrame(rows, TURNS).repartition(3)
    for recent, most in ((3, 12), (1, 5), (0, 4), (4, 10_000)):
        found = {(r.session_id, r.turn_id): (r.context, r.context_tokens, r.summary, r.recent_message_count) for r in session.chat_turns(table, recent, most).collect()}
        assert found == {(s, k): row for s, ms in talks.items() for k, row in enumerate(_chat(ms, recent, most))}
    # the stream, over several batches and a restart, tells the same
    kept = [c for c in ("turn_id < 4", "turn_id >= 4 and turn_id < 9", "turn_id >= 8")]
    out = []
    for n, part in enumerate(kept):
        table.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
        out += _run(state.chat_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "turns")), 3, 12), tmp_path / "c")
    wanted = {(str(s), k): row for s, ms in talks.items() for k, row in enumerate(_chat(ms, 3, 12))}
    assert len(out) == len(wanted) and {(r.session_id, r.turn_id): (r.context, r.context_tokens, r.summary, r.recent_message_count) for r in out} == wanted


def test_resolution_of_many_names_is_the_linear_search():
    """Names with shared parts against a search through all nodes, turns out of order too; and 100,000 names in one session."""
    import random
    import time

    rng = random.Random(17)
    words = ["load", "store", "parse", "route", "index", "token", "merge", "split", "cache", "graph"]
    made = graph.Graph()
    nodes = []  # [etype, name, parts, first, last, count, aliases]
    for turn in [*range(300), 250, 12, 400, 13]:
        named = list(dict.fromkeys((rng.choice(["file", "function"]), "_".join(rng.choices(words, k=rng.randrange(1, 6)))) for _ in range(rng.randrange(3))))
        content = rng.choice(["", "fix it", "that file", "this function here"])
        said = list(named)
        for etype, pattern in graph._REFERENCES:
            of = [n for n in nodes if etype in (None, n[0])]
            if pattern.search(content) and of:
                target = max(of, key=lambda n: (n[4], -nodes.index(n)))
                use = etype or next(n[0] for n in nodes if n[1] == target[1])
                if (use, target[1]) not in said:
                    said.append((use, target[1]))
        kinds = list(dict.fromkeys(t for t, _ in said))
        for etype, name in sorted(said, key=lambda m: kinds.index(m[0])):
            own, best, most = set(graph.name_parts(name)), name, 0.0
            for n in nodes if own else []:
                share = len(own & n[2]) / max(len(own), len(n[2]), 1)
                if share >= 0.7 and share > most:
                    best, most = n[1], share
            known = next((n for n in nodes if (n[0], n[1]) == (etype, best)), None)
            if known is None:
                nodes.append([etype, best, set(graph.name_parts(best)) | own, turn, turn, 1, [name] if name != best else []])
            else:
                known[4], known[5] = turn, known[5] + 1
                if name != best and name not in known[6]:
                    known[6].append(name)
                    known[2] |= own
        made.add(turn, content, named)
    found = [(n["etype"], n["name"], n["first_seen_turn"], n["last_seen_turn"], n["mention_count"], n["aliases"]) for n in made.nodes.values()]
    assert found == [(n[0], n[1], n[3], n[4], n[5], n[6]) for n in nodes]
    assert (made.entities, made.mentions) == (len(nodes), sum(n[5] for n in nodes))
    begin, big = time.monotonic(), graph.Graph()
    spelled = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(5))
    for turn in range(20_000):
        big.add(turn, "", [("function", f"{spelled(5 * turn + k)}_{words[turn % 10]}_{words[k]}") for k in range(5)])
    assert big.mentions == 100_000 == big.entities
    assert time.monotonic() - begin < 60


def test_logs_in_batch_and_stream_keep_bad_lines(spark, tmp_path):
    said = lambda t: [{"role": "user", "content": t}]
    parts = [
        [json.dumps({"messages": said("a")}), '{"messages": [', json.dumps({"request": {"messages": said("b")}}), json.dumps({"other": 1})],
        [json.dumps({"messages": said("c"), "model": "gpt-4o", "session_id": "s"}), "no json", json.dumps({"messages": []})],
    ]
    (tmp_path / "in").mkdir()
    out = []
    for n, lines in enumerate(parts):  # a stream takes each file once, over restarts too
        (tmp_path / "in" / f"{n}.jsonl").write_text("\n".join(lines) + "\n")
        out += _run(chat.read_log(spark, str(tmp_path / "in"), streaming=True), tmp_path / "c", "append")
    batch = chat.read_log(spark, str(tmp_path / "in")).collect()
    assert sorted(map(str, out)) == sorted(map(str, batch))
    assert sorted(r.bad for r in batch if r.bad) == ["no json", '{"messages": [']
    assert sorted(r.messages[0].content for r in batch if r.bad is None) == ["a", "b", "c"] and all((r.conv_id is None) == (r.bad is not None) for r in batch)
    turns_ = chat.turns_of(chat.read_log(spark, str(tmp_path / "in")).where("bad is null"))
    assert sorted(r.content for r in turns_.collect()) == ["a", "b", "c"]
    requests = chat.read_requests(spark, str(tmp_path / "in")).collect()
    assert len(requests) == 7 and sum(r.bad is not None for r in requests) == 2 and sum(r.session_id == "s" for r in requests) == 1
