"""File sources, ingest, snapshot store, streams and the memory object."""

import os

import pytest
from pyspark.sql import functions as F

from engramql.memory import NO_ANSWER, Memory
from engramql.sources import files, ingest
from engramql.sources.store import SnapshotStore
from engramql.streaming import pipelines as P


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("before\nAnn Lee: hello\nmore\n\nBob: \nCid: bye\n")
    (tmp_path / "b.vtt").write_text("WEBVTT\n\n1\n00:01.000 --> 00:02.000\n<v Ann>hi there</v>\nBob: yes\nnote\n")
    (tmp_path / "sub" / "c.md").write_text("# One\ntext [[two]]\n\n## Two\nmore\n")
    (tmp_path / "d.md").write_text("two")
    return str(tmp_path)


def test_transcripts(spark, folder):
    turns = files.speaker_turns(files.read_files(spark, folder, "*.txt")).orderBy("turn").collect()
    assert [(r.speaker, r.text) for r in turns] == [("Unknown", "before"), ("Ann Lee", "hello\nmore"), ("Cid", "bye")]
    captions = files.caption_turns(files.read_files(spark, folder, "*.vtt")).orderBy("turn").collect()
    assert [(r.speaker, r.text) for r in captions] == [("Ann", "hi there"), ("Bob", "yes")]


def test_vault_and_cursor(spark, folder):
    notes = files.read_files(spark, folder, "*.md")
    assert {r.text for r in files.note_chunks(notes, 20).collect()} == {"# One\ntext [[two]]\n\n", "## Two\nmore\n", "two"}
    ids = files.external_ids(files.note_chunks(notes), folder).select("external_id").collect()
    assert {r.external_id.split("#")[0] for r in ids} == {"sub/c.md", "d.md"}
    assert files.read_files(spark, folder, "*.md", after_ms=files.cursor(notes)).count() == 0
    assert files.fingerprint(notes).endswith(":2")


def test_seed(spark, folder):
    nodes, edges = files.seed_nodes(files.read_files(spark, folder, "*.md"))
    assert {r.value for r in nodes.collect()} == {"# One\ntext [[two]]", "## Two\nmore", "two"}
    assert edges.count() == 1


def test_memory_files_and_survey(spark, tmp_path):
    base = tmp_path / "-Users-u-alpha" / "memory"
    os.makedirs(base)
    for n in ("MEMORY.md", "policy.md", "note.md"):
        (base / n).write_text("x")
    got = {r.name: r for r in files.memory_files(files.read_files(spark, str(tmp_path), "*.md"), ("policy",)).collect()}
    assert {n: r.skip_reason for n, r in got.items()} == {"MEMORY.md": "memory-index", "policy.md": "policy-bundle", "note.md": None}
    assert (got["note.md"].cwd, got["note.md"].scope, got["note.md"].external_id) == ("/Users/u/alpha", "alpha", "memory-import:alpha:note.md")
    lines = files.survey_lines(spark.createDataFrame([("build", "- one\n2) two\n\nI'm sorry, no\n"), ("deps", "I cannot help")], "area string, answer string"))
    assert [(r.area, r.pos, r.text) for r in lines.orderBy("pos").collect()] == [("build", 1, "one"), ("build", 2, "two")]


RAW = "id string, ts bigint, content string, role string, source string, external_id string, session_id string, cwd string"


def test_append_is_idempotent(spark):
    raw = spark.createDataFrame([("1", 5, "token=abc always", "user", "claude-code", None, "s", ""), ("2", 4, "x", "user", "gmail", "e", "s", ""), ("3", 6, "x", "user", "gmail", "e", "s", ""), ("4", 1, None, "tool", "gcal", None, None, None)], RAW)
    first = ingest.new_rows(ingest.prepare(raw, 0), None)
    rows = {r.id: r for r in first.collect()}
    assert set(rows) == {"1", "2", "4"}
    assert rows["1"].content == "[REDACTED:SECRET] always" and rows["1"].hard_keep and rows["4"].content == ""
    assert ingest.new_rows(ingest.prepare(raw, 0), first).count() == 0


def test_normalisers(spark):
    m = ingest.mail_records(spark.createDataFrame([("m", "a@b", "Hi", 5, "new\n> old\nend\n-- \nsig")], "message_id string, sender string, subject string, sent_ms bigint, body string")).first()
    assert m.content == "From: a@b\nSubject: Hi\n\nnew\nend" and m.source == "gmail"
    e = spark.createDataFrame([(1, "acc", "ev", "Sync", "d", ["RRULE:FREQ=DAILY"])], "raw_id bigint, account_id string, id string, summary string, description_text string, recurrence array<string>")
    c = ingest.calendar_records(e, spark.createDataFrame([(1, 0)], "raw_id bigint, start_ms bigint")).first()
    assert c.content == "Sync · 1970-01-01T00:00:00.000Z · Event: ev · RRULE: FREQ=DAILY\nd" and c.external_id == "acc/ev"


def test_store_versions(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}/store", keep=2)
    assert s.read("t") is None
    for i in range(4):
        s.publish("t", spark.range(i + 1))
    assert s.current("t") == 4 and s.read("t").count() == 4 and s.versions("t") == [3, 4] and s.read("t", 3).count() == 3


def test_stream_appends_once(spark, tmp_path):
    raw = spark.createDataFrame([("1", 10, "always a", "user", "claude-code", "k", "s", ""), ("2", 20, "b", "user", "claude-code", "k", "s", ""), ("3", 30, "c", "user", "claude-code", None, "s", "")], RAW)
    inbox = f"{tmp_path}/in"
    raw.coalesce(1).write.parquet(inbox)
    store = SnapshotStore(spark, f"file://{tmp_path}/store")

    def drain(checkpoint):
        rows = P.prepared_episodes(P.file_stream(spark, inbox, raw.schema), 0)
        P.append_batches(rows, store).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()

    drain("c1")
    assert store.read("episode").count() == 2
    drain("c2")  # the source again from its start
    assert store.read("episode").count() == 2


def test_stream_state_and_join(spark, tmp_path):
    schema = "node_id string, session_id string, origin string, ts bigint"
    rows = [("n", f"s{i}", "observed", i) for i in range(3)] + [("m", "s1", "observed", 1), ("m", "s1", "observed", 2), ("k", "s1", "inferred", 1)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/claims")
    out = P.run_to_table(P.contradiction_counts(P.file_stream(spark, f"{tmp_path}/claims", spark.createDataFrame([], schema).schema)), "update")
    assert {(r.node_id, r.sessions, r.forced) for r in out.collect()} == {("n", 0, True), ("m", 1, False)}
    texts = spark.createDataFrame([("a", 100_000, "x", "observed"), ("b", 50_000, "x", "inferred"), ("c", 150_000, "x", "inferred"), ("d", 60_000, "y", "inferred")], "id string, ts bigint, digest string, origin string")
    texts.coalesce(1).write.parquet(f"{tmp_path}/texts")
    s = P.file_stream(spark, f"{tmp_path}/texts", texts.schema).withColumn("at", F.timestamp_millis("ts"))
    pairs = P.run_to_table(P.echo_stream(s.where("origin <> 'inferred'"), s.where("origin = 'inferred'")), "append")
    assert [(r.id, r.echo_of) for r in pairs.collect()] == [("a", "b")]


def test_memory_end_to_end(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/m")
    schema = "content string, role string, session_id string, ts bigint, source string"
    day = 86_400_000
    assert m.ask("Where is the cache", day) == NO_ANSWER
    add = lambda text, session, ts: m.add(spark.createDataFrame([(text, "user", session, ts, "claude-code")], schema), ts)
    assert add("Always remember the cache server listens on port 6379.", "s1", day) == 1
    assert m.consolidate(2 * day) == {"unrelated": 1}
    assert m.consolidate(2 * day) == {}
    add("Always remember the cache server listens on port 6379.", "s2", 3 * day)
    assert m.consolidate(3 * day) == {"confirm": 1}
    node = m.live.first()
    assert node.c == pytest.approx(0.525) and node.embedding is not None
    assert m.search("cache server port").first().id == node.id
    assert "6379" in m.ask("What port does the cache server listen on?", 4 * day)
    assert m.episodes.where("origin = 'inferred' AND salience = 0").count() == 2
    assert m.events.count() == 2 and m.graph()[0].count() == 1


def test_remember_ambient_and_snapshots(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/m")
    assert m.remember("the build runs on port 8080 every night", "s", 1000) == {"unrelated": 1}
    value = m.live.first().value
    assert m.remember(value, "s", 2000) == {}
    assert m.ambient("build runs on port 8080 every night") == [f"- {value}"]
    shot = m.record_snapshot([value], 3000)
    assert [r.same for r in m.replay_snapshot(shot).collect()] == [True]


def test_turns_of_any_line_end(spark):
    docs = spark.createDataFrame([("a", "Ann: hi\r\nmore\r\nBob: yo\r\n"), ("b", "x\ry\nCid: z")], "path string, content string")
    got = {(r.path, r.turn): (r.speaker, r.text) for r in files.speaker_turns(docs).collect()}
    assert got == {("a", 1): ("Ann", "hi\nmore"), ("a", 2): ("Bob", "yo"), ("b", 0): ("Unknown", "x\ry"), ("b", 1): ("Cid", "z")}


def test_store_never_shows_a_part(spark, tmp_path):
    """No step of a write takes the table away, and a lost writer leaves the last version."""
    s = SnapshotStore(spark, f"file://{tmp_path}/store", keep=2)
    s.publish("t", spark.range(3))
    s._write("t", spark.range(100))  # a writer that is lost before its manifest
    (tmp_path / "store" / "t" / ".next-x").write_text("nothing")
    assert s.current("t") == 1 and s.read("t").count() == 3
    reader = s.read("t")
    s.append("t", spark.range(3, 5))
    assert s.current("t") == 2 and sorted(r.id for r in s.read("t").collect()) == [0, 1, 2, 3, 4] and reader.count() == 3
    assert s.parts("t", 2)[:1] == s.parts("t", 1)
    with pytest.raises(RuntimeError):
        s._commit("t", 2, s.parts("t", 1))
    for i in range(3):
        s.append("t", spark.range(5 + i, 6 + i))
    assert s.read("t").count() == 8 and s.versions("t") == [4, 5]
    s.publish("t", spark.range(1))
    s.publish("t", spark.range(2))
    assert s.read("t").count() == 2 and len([p for p in os.listdir(tmp_path / "store" / "t") if p.startswith("part-")]) == 3  # the lost one too


def test_pulls_and_cursors(spark):
    schema = "account_id string, id string, status string"
    stored = spark.createDataFrame([("a", "1", "confirmed"), ("a", "2", "confirmed"), ("a", "3", "cancelled"), ("b", "9", "confirmed"), ("a", "5", None)], schema)
    pulled = spark.createDataFrame([("a", "1", "tentative"), ("a", "1", "tentative"), ("a", "4", "confirmed"), ("a", "6", "cancelled"), ("a", "5", None), ("a", None, "x")], schema)
    some = {(r.id, r.change) for r in ingest.pulled_events(stored, pulled, False).collect()}
    assert some == {("1", "changed"), ("4", "new")}
    assert {(r.id, r.change) for r in ingest.pulled_events(stored, pulled, True).collect()} == some | {("2", "cancelled")}
    mails = spark.createDataFrame([("x", 5), ("y", 7)], "id string, history bigint")
    fresh, top = ingest.after_cursor(mails, "history", 5)
    assert [r.id for r in fresh.collect()] == ["y"] and fresh.agg(top.alias("c")).first().c == 7
    fresh, top = ingest.after_cursor(mails, "history", 7)
    assert fresh.agg(top.alias("c")).first().c == 7 and ingest.after_cursor(mails, "history", None)[0].count() == 2


def test_a_bad_episode_stays_open(spark, tmp_path):
    from engramql.functions import seams

    def extract(text):
        if "poison" in text:
            raise ValueError("no")
        return seams.extract(text)

    m = Memory(spark, f"file://{tmp_path}/m", extract=extract)
    rows = [(f"Always remember {x} and the cache server port.", "user", x, 5, "claude-code") for x in ("poison", "water")]
    m.add(spark.createDataFrame(rows, "content string, role string, session_id string, ts bigint, source string"), 5)
    assert m.consolidate(6) == {"unrelated": 1}
    assert {r.session_id: r.consolidated for r in m.episodes.collect()} == {"poison": False, "water": True}
