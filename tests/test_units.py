"""Literal cases for every branch that the shared tables do not reach."""

import json
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from memlake import schemas
from memlake.functions import documents as dc, scores as sc, text as tx, timeaxis as ta
from memlake.operators import landmarks, merging
from memlake.operators.diversity import assemble, diversify
from memlake.plans import daily, decay, embedding, extract, late_turns, preserve, recent, weekly, write
from memlake.settings import Settings
from memlake.sources import message_log, message_tables, tables
from memlake.streaming import intake


def column(spark, values, expression, ddl="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {ddl}")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_redaction(spark):
    texts = ["key sk-abcdefghij1234 end", "API_KEY = abcdefghijkl", "call 13812345678", "mail jöhn.doe+x@exämple.org now",
             "id 123456789 and 1234567890", "ip 10.20.30.40.", "short 12345678", "sk-short"]
    assert column(spark, texts, tx.redact) == [
        "key [REDACTED] end", "[REDACTED]", "call [REDACTED]", "mail [REDACTED] now", "id [REDACTED] and [REDACTED]",
        "ip [REDACTED].", "short 12345678", "sk-short"]


def test_user_text(spark):
    envelope = ("Conversation info (untrusted metadata):\n```json\n{}\n```\nSender (untrusted metadata):\n```json\n{}\n```\n")
    audio = "[Audio]\nUser text:\n[Telegram bob] \n hello \n\n there\nTranscript:\nheard"
    texts = [envelope + "hi", envelope, "  [[reply_to_current]] [[reply_to:9]]\nyes\n[[reply_to:3]] no", audio,
             "[Audio] [Telegram x] User text: Transcript: only this", "[Audio] plain"]
    got = column(spark, texts, tx.clean_user_text)
    assert [g.text for g in got] == ["hi", envelope, "yes\nno", "hello\nthere", "only this", "[Audio] plain"]
    assert [g.message_type for g in got] == ["text", "text", "text", "audio", "audio", "text"]


def test_message_log_files(spark, tmp_path):
    def line(stamp, role, content, kind="message"):
        return json.dumps({"type": kind, "timestamp": stamp, "message": {"role": role, "content": content}})

    agent = tmp_path / "agent_x"
    agent.mkdir()
    blocks = [{"type": "thinking", "text": "no"}, {"type": "text", "text": " a "}, {"type": "text", "text": "b"},
              {"type": "toolCall", "name": "Read", "arguments": {"path": "/p"}},
              {"type": "toolCall", "name": "exec", "arguments": {"command": "mail me@here.org " + "y" * 300}}]
    (agent / "s1.jsonl").write_text("\n".join([
        line("2024-06-01T10:00:00Z", "user", "hello"), "", "{broken", line("nope", "user", "x"),
        line("2024-06-01T12:00:01+02:00", "assistant", blocks), line("2024-06-01T10:00:02Z", "toolResult", "r"),
        line("2024-06-01T10:00:03Z", "user", "x", kind="other"), line("2024-06-02T01:59:00Z", "user", " "),
        line("2024-06-02T01:59:59Z", "user", "late") + "]"]))
    (agent / "s1.jsonl.reset.2024").write_text(line("2024-06-01T09:00:00Z", "user", "old version"))
    (agent / "s2.jsonl.reset.1").write_text(line("2024-06-01T09:00:00Z", "user", "older"))
    (agent / "s2.jsonl.reset.2").write_text(line("2024-06-02T01:59:59Z", "user", "newer"))
    days = extract.extract_log_days(message_log.read_message_log(spark, str(tmp_path)))
    turns = days["turns"].orderBy("memory_date", "turn_index").collect()
    assert [(str(t.memory_date), t.turn_index, t.session_id, t.content, t.hhmm) for t in turns] == [
        ("2024-06-01", 0, "s1", "hello", "11:00"), ("2024-06-01", 1, "s1", "a b", "11:00"),
        ("2024-06-01", 2, "s2", "newer", "02:59")]
    stats = days["day_stats"].collect()[0]
    assert (stats.total_turns, stats.user_turns, stats.assistant_turns, stats.tools_called_count) == (4, 3, 1, 2)
    items = {(r.kind, r.item) for r in days["tool_items"].collect()}
    assert ("files_read", "/p") in items and ("tools_used", "exec") in items
    command = next(i for k, i in items if k == "commands_run")
    assert command.startswith("mail [REDACTED] yyy") and command.endswith("...")
    assert days["day_markers"].count() == 0 and days["l1_days"].columns[0] == "agent_id"


def test_message_tables(spark):
    messages = spark.createDataFrame([
        (1, "c", "user", "replayed", 10.0, None), (2, "c", "assistant", " [CONTEXT COMPACTION] x", 11.0, None),
        (3, "c", "user", "fresh", 12.0, None), (4, "p", "assistant", "[CONTEXT COMPACTION] kept", 13.0, '{"name": "edit", "arguments": {"path": "f"}}'),
        (5, "p", "user", "  ", 14.0, None), (6, "p", "tool", "t", 15.0, None)],
        "id bigint, session_id string, role string, content string, timestamp double, tool_calls string").withColumn("agent_id", F.lit("a"))
    sessions = spark.createDataFrame([("c", "cli", "", "p"), ("p", "cli", "", None)], "id string, source string, title string, parent_session_id string")
    days = extract.extract_table_days(messages, sessions)
    assert [r.content for r in days["turns"].orderBy("turn_index").collect()] == ["fresh", "[CONTEXT COMPACTION] kept"]
    assert days["day_stats"].collect()[0].tools_called_count == 1
    assert {(r.kind, r.item) for r in days["tool_items"].collect()} == {("tools_used", "edit"), ("files_written", "f")}


def test_logical_days_over_clock_changes(spark):
    stamps = ["2024-03-31 01:59:59", "2024-03-31 02:00:00", "2024-10-27 02:59:59", "2024-10-27 03:00:00", "2024-01-01 02:59:59"]
    got = column(spark, stamps, lambda c: ta.logical_day(c.cast("timestamp")).cast("string"))
    assert got == ["2024-03-30", "2024-03-31", "2024-10-26", "2024-10-27", "2023-12-31"]
    assert column(spark, ["2024-07-02 01:30:00"], lambda c: ta.previous_logical_day(c.cast("timestamp")).cast("string")) == ["2024-06-30"]


def test_time_keys(spark):
    rows = [("surface", "2024-02-29"), ("surface", "2023-02-29"), ("shallow", "2020-W53"), ("shallow", "2021-W53"), ("shallow", "x"),
            ("deep", "2024-01-01+35d"), ("deep", "2024-01-01"), ("deep", "2024-01-01+xd"), ("other", "2024-01-01")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, depth string, key string")
    got = [str(r.x) for r in df.select("i", ta.characterized_date(F.col("depth"), F.col("key")).alias("x")).orderBy("i").collect()]
    assert got == ["2024-02-29", "None", "2020-12-31", "None", "None", "2024-01-18", "2024-01-01", "None", "None"]
    assert column(spark, ["2024-W01"], lambda c: ta.shift_week(c, -1)) == ["2023-W52"]
    assert ta.date_window("2024-02-01, 2024-01-01") == (date(2024, 1, 1), date(2024, 2, 1))
    assert weekly.weeks_between(date(2024, 1, 3), date(2024, 1, 20)) == ["2024-W01", "2024-W02"]
    weeks = spark.range(1).select(ta.complete_weeks(F.lit("2024-01-03").cast("date"), F.lit("2024-01-20").cast("date")).alias("w")).first().w
    assert weeks == ["2024-W01", "2024-W02"]


def test_landmark_branches(spark):
    cases = [({}, {}, 0.0, False), ({"milestone": 1}, {}, 0.5, False), ({"milestone": 3, "bug_fix": 4, "incident": 2}, {5: 1}, 6.9, True),
             ({"bug_fix": 1, "incident": 1}, {5: 2}, 5.4, False), ({"milestone": 2, "bug_fix": 1, "incident": 1}, {3: 4}, 4.5, False),
             ({"milestone": 1, "bug_fix": 1, "incident": 2}, {5: 1, 0: 2}, 5.9, True), ({}, {4: 1}, 0.4, False)]
    counts = spark.createDataFrame([(str(i), date(2024, 1, 1), k, v) for i, (k, v, _, _) in enumerate(cases)], schemas.LANDMARK_COUNTS)
    got = {r.agent_id: (r.score, r.landmark) for r in landmarks.judge(landmarks.analyze_counts(counts)).collect()}
    assert got == {str(i): (s, v) for i, (_, _, s, v) in enumerate(cases)}


def test_fusion_and_penalty(spark):
    rows = spark.createDataFrame([(0, .8, .9, True), (1, .8, .3, True), (2, .3, .8, True), (3, .5, .5, True), (4, .8, .9, False)],
                                 "i int, l double, e double, h boolean")
    got = [round(r.x, 4) for r in rows.select("i", sc.gated_fuse(F.col("l"), F.col("e"), F.col("h")).alias("x")).orderBy("i").collect()]
    assert got == [.85, .625, .625, .5, .8]
    texts = ["Action: x\nSESSION_KEY: y", "action: only", "nothing"]
    assert column(spark, texts, lambda c: sc.runtime_penalty(F.lit(0.5), c)) == [0.15, 0.5, 0.5]


def test_lexical_score(spark):
    cases = [("alpha beta", "Alpha, alphabet!", 1.0), ("alphabet", "alpha", 0.5), ("alpha alpha", "alpha", 2.0), ("alp", "alphabet", 0.5),
             ("zeta", "alpha", 0.0), ("x" * 50, "x", 0.5), ("x" * 50 + "y", "x" * 50, 0.5), ("alpha", "...", 0.0)]
    from memlake.plans.recall import query_terms, searchable, _lexical
    df = spark.createDataFrame([(i, q, t) for i, (q, t, _) in enumerate(cases)], "i int, query string, t string")
    got = {r.i: r.s for r in searchable(query_terms(df), "t").select("i", _lexical().alias("s")).collect()}
    assert got == {i: s for i, (_, _, s) in enumerate(cases)}


def test_cosine_edges(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], [1.0, 1.0]), (1, [], []), (2, [1.0], [1.0, 2.0]), (3, [0.0], [1.0]), (4, None, [1.0])],
                                 "i int, a array<double>, b array<double>")
    got = [r.x for r in rows.select("i", sc.cosine(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert got == [pytest.approx(2 ** -.5), 0.0, 0.0, 0.0, 0.0]


def test_diversity_rules(spark):
    rows = [("q", "k1", f, s, lay, t) for f, s, lay, t in [
        ("summary", .9, "l1", "one two three four"), ("todo", .8, "l1", "one two three five"), ("decision", .7, "l1", "six seven"),
        ("conversation_excerpt", .6, "l2", "one two three four nine"), ("key_item", .5, "l1", "eight")]] + [
        ("q", "k2", "summary", .4, "l1", "six  seven"), ("q", "k2", "todo", .3, "l1", "ten")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)],
                               "query_id string, time_key string, field string, final_score double, source_layer string, information string, layer_rank int")
    df = df.withColumn("weighted_score", F.col("final_score")).withColumn("normalized", tx.dedupe_text(F.col("information"))).withColumn("rendered", F.col("information"))
    chosen = diversify(df, 8)
    # The second is too close to the first; the turn is too, but it is the first turn of its day; then k1 is full.
    assert [r.information for r in chosen.orderBy("rank").collect()] == ["one two three four", "six seven", "one two three four nine", "ten"]
    text = assemble(chosen, 12_000).first().assembled_text
    assert text == "### 相关摘要\n- one two three four\n- six seven\n- ten\n### 相关对话摘录\n- one two three four nine"
    cut = assemble(chosen, 60).first().assembled_text
    assert cut == "### 相关摘要\n- one two three four\n- six seven\n- ten\n### 相关对话摘录"[:60].rstrip()
    assert len(assemble(chosen, 5).first().assembled_text) == 0


def test_recent_view(spark):
    topic, item = [("n", "d")], [("bug_fix", "it"), ("", "plain")]
    rows = [("a", date(2024, 1, 9), "new", topic, ["dec"], [" "], item), ("a", date(2024, 1, 7), None, None, None, None, None)]
    l1 = spark.createDataFrame(rows, f"agent_id string, memory_date date, summary string, topics {schemas.TOPICS}, decisions array<string>, "
                                     f"todos array<string>, key_items {schemas.KEY_ITEMS}")
    agents = spark.createDataFrame([("a", date(2024, 1, 10))], "agent_id string, today date")
    out = recent.recall_recent(agents, l1, 3).first()
    assert out.assembled_text == ("### 最近记忆概览\n- 2024-01-09: new\n- 2024-01-07: （无摘要）\n[2024-01-09]\n摘要：new\n主题：\n- n: d\n"
                                  "关键事项：\n- [bug_fix] it\n- plain\n决策：\n- dec\n[2024-01-07]\n摘要：（无摘要）")
    assert out.missing_dates == [date(2024, 1, 8)]
    short = recent.recall_recent(agents, l1, 3, Settings(max_chars=70)).first().assembled_text
    assert len(short) <= 70 and short.startswith("### 最近记忆概览\n- 2024-01-09: new")
    tight = recent.recall_recent(agents, l1, 3, Settings(max_chars=66)).first().assembled_text
    assert tight.endswith("…") or tight.endswith("[2024-01-09]")
    assert recent.field_tier(7) == {"summary", "topics"} and recent.field_tier(8) == {"summary"}


def test_documents(spark):
    texts = ['{"a": 1}', '```json\n{"a": 1}\n```', 'x {"a": 1} y', '{"a": 1}],', '{"a": 1', "", '{"a": 1} {"b": 2}', '{"a": 1}}', "[1]", None]
    got = column(spark, texts, dc.repair_json)
    assert [g.method if g else None for g in got] == [
        "direct", "strip_markdown_fence", "extract_outer_json_object", "extract_outer_json_object", None, None, None, "direct"[:0] or None, "direct", None]


def test_model_callables_and_retries(spark):
    fragments = spark.createDataFrame([("a", date(2024, 1, 1), 1, 1, i, "user", "09:00", f"text {i}", 0, 3) for i in range(3)],
                                      "agent_id string, memory_date date, chunk_id bigint, total_chunks bigint, turn_index bigint, role string, "
                                      "hhmm string, text string, from_char bigint, token_estimate bigint")

    def model(batches):
        for batch in batches:
            yield pd.DataFrame({"agent_id": batch["agent_id"], "memory_date": batch["memory_date"], "chunk_id": batch["chunk_id"],
                                "raw": ["```\n" + json.dumps({"n": len(f)}) + "\n```" for f in batch["fragments"]]})

    out = write.read_model_output(write.infer_map(fragments, model, parallel=2)).first()
    assert (out.method, out.problem) == ("strip_markdown_fence", "keys")
    calls = []

    def run(rows):
        calls.append(rows.count())
        return rows.withColumn("valid", F.col("chunk_id") % 2 == len(calls) % 2)

    rows = spark.createDataFrame([("a", date(2024, 1, 1), i) for i in range(6)], "agent_id string, memory_date date, chunk_id bigint")
    assert write.retry_failed(rows, run, 1).filter("valid").count() == 6 and calls == [6, 3]


def test_low_days_leave_a_marker(spark):
    stats = spark.createDataFrame([("a", date(2024, 1, 1), 2, 0), ("a", date(2024, 1, 2), 2, 1)], "agent_id string, memory_date date, total_turns bigint, user_turns bigint")
    empty = ([],) * 4
    summaries = spark.createDataFrame([("a", date(2024, 1, 1), "low", [], [], [], "s", [], [], "", [], []),
                                       ("a", date(2024, 1, 2), "normal", [("t", "d")], ["x"], [], "sum", [], ["g"], "", [], [1])],
                                      f"agent_id string, memory_date date, {schemas.DAY_SUMMARY}")
    filled, markers = write.finalize_days(write.l1_skeleton(stats), summaries)
    row = filled.first()
    assert filled.count() == 1 and (row.summary, row.compress_hints, row.status.filled, row.total_turns) == ("sum", [1], True, 2)
    assert [(str(m.memory_date), m.marker) for m in markers.collect()] == [("2024-01-01", "nocontent")]
    again, _ = write.finalize_days(filled, summaries)
    assert again.first().summary == "sum"


def test_archive_and_restore_round_trip(spark, sf):
    from memlake.catalog.lifecycle import store
    full = store(spark, sf)
    archive = preserve.archive_weeks(full)
    emptied = {name: df.limit(0) for name, df in full.items()}
    week = archive["l1_days"].select("week_id").first().week_id
    back = preserve.restore(emptied, preserve.select_for_restore(archive, week=week), "update")
    keys = {"l1_days": ["agent_id", "memory_date"], "turns": ["agent_id", "memory_date", "turn_index"], "l0_index": ["agent_id", "time_key"]}
    for name, key in keys.items():
        want = {tuple(r) for r in archive[name].filter(F.col("week_id") == week).select(key).collect()}
        assert {tuple(r) for r in back[name].select(key).collect()} == want and want
    assert back["l1_days"].filter("NOT status.restored").count() == 0
    only = preserve.select_for_restore(archive, on=archive["l1_days"].first().memory_date, levels=("l2",))
    assert "l1_days" not in only and only["day_markers"].filter("marker = 'nocontent'").count() == 0


def test_a_week_without_cleanup_deletes_nothing_and_repeats_nothing(spark, sf):
    """Three weeks without cleanup: every agent has one row per week and window, however often it is rolled up."""
    from memlake.catalog.weekly import _folder, lifecycle_store
    store = lifecycle_store(spark, sf)
    before = store.read("l1_days").count()
    assert weekly.backfill_weeks(store, date(2024, 1, 1), date(2024, 1, 21), settings=Settings(deep_weeks=2)) == [f"2024-W0{i}" for i in range(1, 4)]
    agents, rollups = store.read("agents").count(), store.read("rollups")
    assert store.read("l1_days").count() == before and store.read("shallow_weeks").count() == 3 * agents
    assert rollups.where("depth = 'shallow'").count() == 3 * agents and rollups.where("depth = 'deep'").count() == agents
    assert rollups.select("agent_id", "depth", "time_key").distinct().count() == rollups.count()
    for table in ("turns", "rollups", "l0_index"):  # read from files: the plan does not remember the weeks
        assert store.read(table)._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    version = store.version()["name"]
    assert weekly.backfill_weeks(store, date(2024, 1, 1), date(2024, 1, 21), settings=Settings(deep_weeks=2)) == []
    assert store.version()["name"] == version


def test_an_interrupted_archive_is_invisible(spark, sf, tmp_path, monkeypatch):
    from memlake.catalog.lifecycle import store as lifecycle_tables
    from memlake.sources import archive_files
    from memlake.sources.snapshots import Store
    tables_, path = lifecycle_tables(spark, sf), str(tmp_path / "archive")
    weeks = weekly.weeks_between(date(2024, 1, 1), date(2024, 1, 21))
    assert archive_files.write_archive(tables_, path, weeks[:1]).count() > 0
    counts = lambda: (archive_files.manifest(spark, path).count(), Store(spark, path).read("turns").count())
    first = counts()
    monkeypatch.setattr(Store, "_move", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        archive_files.write_archive(tables_, path, weeks)
    monkeypatch.undo()
    assert counts() == first
    archive_files.write_archive(tables_, path, weeks)
    assert counts()[0] >= first[0] and archive_files.write_archive(tables_, path, weeks).count() == 0
    # A restore lists the files of its week only.
    back = archive_files.read_archive(spark, path, week=weeks[0])
    assert {f.split("/data/")[1].split("/")[1].split("=")[1] for f in back["turns"].inputFiles()} == set(Store(spark, path).parts("turns", {"week_id": [weeks[0]]}))


def test_only_changed_texts_are_embedded(spark):
    asked = []

    def embed(rows):
        rows = rows.withColumn("embedding", F.array(F.length("text_used").cast("double")))
        asked.append(sorted((r.depth, r.time_key) for r in rows.collect()))
        return rows

    ddl = schemas.L0_INDEX
    row = lambda depth, key, text: ("a", depth, key, text, ["t"], "", None, 0)
    index, vectors = spark.createDataFrame([], ddl), spark.createDataFrame([], embedding.EMBEDDINGS)
    first = [row("surface", "2024-01-01", "one"), row("shallow", "2024-W01", "week"), row("deep", "2024-01-01+28d", "window")]
    index, vectors = embedding.index_and_embed(index, vectors, spark.createDataFrame(first, ddl), embed, "m1")
    again = [first[0], row("shallow", "2024-W01", "new"), first[2]]
    index, vectors = embedding.index_and_embed(index, vectors, spark.createDataFrame(again, ddl), embed, "m1")
    index, vectors = embedding.index_and_embed(index, vectors, spark.createDataFrame(again[:1], ddl), embed, "m2")
    assert asked == [sorted((r[1], r[2]) for r in first), [("shallow", "2024-W01")], [("surface", "2024-01-01")]]
    got = {r.time_key: (r.text_used, r.embedding[0], r.model) for r in vectors.collect()}
    assert {k: v[2] for k, v in got.items()} == {"2024-01-01": "m2", "2024-W01": "m1", "2024-01-01+28d": "m1"}
    assert all(v[1] == len(v[0]) for v in got.values()) and "new" in got["2024-W01"][0] and index.count() == 3


def test_the_ledger_hands_out_open_days_only(spark):
    day = date(2024, 1, 1)
    ledger = daily.enroll(spark.createDataFrame([], daily.LEDGER), spark.createDataFrame(
        [(a, day) for a in "abc"] + [("a", day)], "agent_id string, memory_date date"))
    handed = lambda l: sorted(r.agent_id for r in daily.hand_out(l, 1).collect())
    outcome = lambda *rows: spark.createDataFrame([(a, day, ok, p) for a, ok, p in rows], "agent_id string, memory_date date, succeeded boolean, problem string")
    assert handed(ledger) == ["a", "b", "c"]
    ledger = daily.settle(ledger, outcome(("a", True, None), ("b", False, "x"), ("c", False, "y")), 1, "r1")
    assert handed(ledger) == ["b", "c"]
    ledger = daily.settle(ledger, outcome(("b", False, "z"), ("c", True, None)), 1, "r2")
    rows = {r.agent_id: (r.status, r.attempts, r.problem, r.run_name) for r in ledger.collect()}
    assert rows == {"a": ("done", 1, None, "r1"), "b": ("failed", 2, "z", "r2"), "c": ("done", 2, None, "r2")} and handed(ledger) == []
    everyone = spark.createDataFrame([(None, day)], "agent_id string, memory_date date")
    assert handed(daily.reopen(ledger, everyone)) == ["b"]


def test_late_turns_move_anchors_and_trimming_keeps_their_turns(spark):
    from memlake.catalog.daily import written_store
    day = date(2024, 1, 5)
    said = [(9, "user", "We decided to ship."), (11, "assistant", "Great news!"), (13, "user", "Plain words here"), (15, "user", "You must call Bob.")]
    make = lambda rows: extract.order_turns(spark.createDataFrame(
        [("a", day, "s", datetime(2024, 1, 5, h), f"{h:02d}:00", r, t, "text", 0) for h, r, t in rows],
        "agent_id string, memory_date date, session_id string, ts timestamp, hhmm string, role string, content string, message_type string, message_id long")).drop("message_id")
    early, late = make([said[0], *said[1:]]), make([(8, "user", "Hello there"), said[1], (10, "user", "Anything")])
    anchored = lambda store: sorted(r.content for r in store.read("turns").join(decay.anchor_turns(store.read("l1_days")).distinct(), ["agent_id", "memory_date", "turn_index"]).collect())
    store = written_store(spark, early)
    kept = anchored(store)
    late_turns.fold_late_turns(store, late)
    turns = [r.content for r in store.read("turns").orderBy("turn_index").collect()]
    assert turns == ["Hello there", "We decided to ship.", "Anything", "Great news!", "Plain words here", "You must call Bob."]
    l1 = store.read("l1_days").first()
    assert anchored(store) == kept and l1.total_turns == 6 and l1.user_turns == 5
    assert [turns[p.turn] for p in l1.emotional_peaks] == ["Great news!"]
    again, scratch = written_store(spark, early), written_store(spark, make([(8, "user", "Hello there"), said[0], (10, "user", "Anything"), *said[1:]]))
    late_turns.fold_late_turns(again, late, daily.built_in())
    plain = lambda s, t: sorted(str(r) for r in s.read(t).drop("status", "memory_month", "period").collect())
    for table in ("turns", "l1_days", "landmark_counts", "l0_index", "l0_embeddings", "day_markers"):
        assert plain(again, table) == plain(scratch, table), table


def test_upserts_are_idempotent(spark, sf):
    from memlake.catalog import fixtures as fx
    index = fx.l0_index(spark, sf)
    fresh = write.index_rows(fx.l1_days(spark, sf))
    once = merging.upsert_index(index, fresh)
    twice = merging.upsert_index(once, fresh)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.select(once.columns).collect()))


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = tables.with_month(spark.createDataFrame([("a", date(2024, m, d)) for m in (1, 2) for d in (1, 2, 3)], "agent_id string, memory_date date"))
    tables.write_layer(df, path, ["memory_month"])
    tables.write_layer(tables.read(spark, path).filter("memory_date = '2024-01-01'"), path, ["memory_month"])
    assert tables.read(spark, path).count() == 4
    emptied = tables.delete_rows(spark, path, spark.createDataFrame([("a", date(2024, 1, 1)), ("a", date(2024, 2, 3))], "agent_id string, memory_date date"),
                                 ["agent_id", "memory_date"])
    assert emptied == 1 and [str(r.memory_date) for r in tables.read(spark, path).orderBy("memory_date").collect()] == ["2024-02-01", "2024-02-02"]


def test_late_turns_find_their_place(spark, tmp_path):
    ddl = "agent_id string, session_id string, message_id bigint, role string, ts timestamp, content string"
    source, table = tmp_path / "in", str(tmp_path / "out")

    def deliver(rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(ddl).json(str(source))
        (intake.stream_turns_to_days(stream, table).option("checkpointLocation", str(tmp_path / "state"))
         .trigger(availableNow=True).start().awaitTermination())

    early, late = datetime(2024, 1, 5, 9), datetime(2024, 1, 5, 11)
    deliver([("a", "s", 1, "user", early, "first"), ("a", "s", 3, "user", late, "third")])
    deliver([("a", "s", 2, "assistant", datetime(2024, 1, 5, 10), "second"), ("a", "s", 3, "user", late, "third")])
    rows = intake.read_turns(spark, table).orderBy("turn_index").collect()
    assert [(r.turn_index, r.content) for r in rows] == [(0, "first"), (1, "second"), (2, "third")]


def test_window_validators(spark):
    assert column(spark, ['{"week": 1}'], lambda c: dc.week_summary_problem(F.try_parse_json(c))) == ["keys"]
    assert column(spark, ['{"window": 1}'], lambda c: dc.window_summary_problem(F.try_parse_json(c))) == ["keys"]


def test_day_summary_keeps_every_finding(spark):
    day = date(2024, 1, 1)
    rows = [("a", day, 1, i, kind, f"{kind} {i:02d}", 0, i * 1000) for i in range(30) for kind in ("decision", "todo", "item:incident", "peak")]
    rows += [("a", day, 1, i, "topic", f"word{i:02d}\ndetail", 40 - i, i) for i in range(30)]
    found = spark.createDataFrame(rows, "agent_id string, memory_date date, chunk_id long, turn_index long, kind string, value string, "
                                        "weight long, place long")
    context = spark.createDataFrame([("a", day, 1, 60, 30, False, False)], "agent_id string, memory_date date, chunks long, turns long, "
                                    "user_turns long, low_allowed boolean, low_forced boolean")
    row = write.infer_reduce(found, context).first()
    assert row.decisions == [f"decision {i:02d}" for i in range(30)] and len(row.todos) == 30
    assert len(row.key_items) == len(row.emotional_peaks) == 30 and row.source_turns == list(range(30))
    assert [t.name for t in row.topics] == [f"word{i:02d}" for i in range(8)] and len(row.tags) == 10


def test_rollup_keeps_the_latest_and_counts_the_rest(spark):
    shape = ("periods array<struct<summary:string,mood:string,tags:array<string>,topics:array<string>,decisions:array<string>,"
             "todos:array<string>,key_items:array<string>,emotional_peaks:array<string>>>")
    days = [(f"Day {d}. " + "x" * 50, "calm", [f"t{d}"], [], [f"d{d}-{i}" for i in range(5)], ["same"], [], []) for d in range(7)]
    for depth, texts in (("shallow", 3), ("deep", 4)):
        merged = decay.merge_periods(F.col("periods"), depth)
        row = spark.createDataFrame([(days,)], shape).select(*[c.alias(n) for n, c in merged.items()]).first()
        assert row.decisions == [f"d{d}-{i}" for d in range(3, 7) for i in range(5)]
        assert row.summary == "；".join(d[0] for d in days[-texts:]) and row.mood == "calm"
        assert row.todos == ["same"] and row.dropped == 15 + 1
    long = [("One. Two. " + "y" * 300, "", [], [], [], [], [], [])]
    merged = decay.merge_periods(F.col("periods"))
    assert spark.createDataFrame([(long,)], shape).select(merged["summary"].alias("s")).first().s == "One. Two."
