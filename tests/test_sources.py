"""Document scans, sinks, adapters, the engine and the streams."""

import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from spindrift import schemas, storage
from spindrift.operators import cache, ledger, timeline
from spindrift.plans import configs, engine, queries
from spindrift.settings import Settings
from spindrift.sources import adapters, documents
from spindrift.streaming import ledger as stream

COST = {"stage": "s2_transcribe", "provider": "openai", "model": "m", "unit": "minute", "quantity": 1.5, "unit_price_usd": 0.01, "usd": 0.017, "estimated": False, "note": ""}


def write(folder, name, value):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(value if isinstance(value, str) else json.dumps(value))


def manifest(video):
    return {"video_id": video, "stages": {"s2_transcribe": {"config_hash": "h", "config": {"a": 1}, "outputs": {"x": "y"}, "costs": [COST, COST]}}, "runs": [{"started": 1.5, "stages_cached": [], "usd": 0.1}]}


def test_scans(spark, tmp_path):
    base = str(tmp_path)
    write(f"{base}/v1", "manifest.json", manifest("v1"))
    write(f"{base}/v2", "manifest.json", manifest("v2"))
    write(f"{base}/v3", "manifest.json", "{broken")
    write(f"{base}/v4", "other.json", {})
    found = documents.recordings(spark, base)
    assert sorted(r.name for r in found.collect()) == ["v1", "v2"]
    assert documents.ledger(found).agg(F.sum("usd")).first()[0] == pytest.approx(0.068)
    assert [r.usd for r in documents.runs(found).collect()] == [0.1, 0.1]
    assert documents.recordings(spark, f"{base}/none").collect() == []
    assert found.select("name").distinct().count() == 2  # no field of a document is asked for
    write(base, "t.json", {"video_id": "v", "segments": [{"start": 0, "end": 1.5, "text": "a"}]})
    assert documents.strict(spark, f"{base}/t.json", schemas.TRANSCRIPT).first().segments[0].end == 1.5
    write(base, "bad.json", {"video_id": "v", "segments": "none"})
    with pytest.raises(Exception):
        documents.strict(spark, f"{base}/bad.json", schemas.TRANSCRIPT).collect()
    write(base, "env", "# note\nA=1\nexport B = \"two words\"\n\nC='x'\n")
    assert sorted(map(tuple, documents.settings(spark, f"{base}/env").collect())) == [("A", "1"), ("B", "two words"), ("C", "x")]


def test_balanced(spark, tmp_path):
    spark.range(5_000).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(5_000).repartition(16).write.parquet(f"{tmp_path}/many")
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/few")
    spark.range(0).write.parquet(f"{tmp_path}/none")
    most = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    read = lambda name: storage.balanced(spark.read.parquet(f"{tmp_path}/{name}"))
    assert most(spark.read.parquet(f"{tmp_path}/one")) == 5_000 and most(read("one")) < 1_000 and read("one").count() == 5_000
    assert "Exchange" not in read("many")._jdf.queryExecution().toString() and "Exchange" not in read("few")._jdf.queryExecution().toString()
    assert read("none").count() == 0


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/table"
    assert documents.state(spark, path, "v string, x int").collect() == []
    documents.overwrite(spark.createDataFrame([("a", 1), ("b", 2)], "v string, x int"), path, "v")
    documents.overwrite(spark.createDataFrame([("b", 3)], "v string, x int"), path, "v")
    assert sorted((r.v, r.x) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
    documents.append(spark.createDataFrame([("k", "p")], "key string, payload string"), f"{tmp_path}/cache")
    kept = documents.state(spark, f"{tmp_path}/cache", "key string, payload string")
    assert documents.cached(kept, "k").count() == 1 and documents.cached(kept, "z").count() == 0


def test_adapters(spark):
    df = spark.createDataFrame([("segment 1",), ("other",)], "prompt string")
    fence = '```json\n{"title": "t"}\n```'
    replies = adapters.chat(df, adapters.CannedChat({"segment 1": fence}), "m", "sys").withColumn("p", adapters.parsed(F.col("reply"), "title string"))
    assert sorted((r.prompt, r.p.title) for r in replies.collect()) == [("other", None), ("segment 1", "t")]
    chunks = spark.createDataFrame([("v", 0, "a", 0.0), ("v", 1, "b", 600.0)], "video_id string, chunk long, path string, offset double")
    said = adapters.transcribe(chunks, adapters.CannedSpeech({"a": ["x"], "b": ["y", "z"]})).orderBy("start").collect()
    assert [(r.start, r.text) for r in said] == [(0.0, "x"), (600.0, "y"), (602.0, "z")]
    chain = adapters.Chain([adapters.FakeVideo("a", 0.1, fails=True), adapters.FakeVideo("b", 0.05)])
    assert chain.estimate(3, 2.0) == pytest.approx(0.6)
    assert chain.generate("p", 2.0, 1).startswith("b/") and chain.active == 1 and chain.estimate(3, 2.0) == pytest.approx(0.3)
    assert adapters.provider("none") is None
    with pytest.raises(ValueError):
        adapters.provider("fake, what")
    spark.dataSource.register(adapters.MetadataSource)
    items = json.dumps([{"video_id": "v", "title": "t", "channel": "c", "duration": 9.5}])
    assert spark.read.format("recordings").option("items", items).load().first().duration == 9.5


def test_calls_run_once(spark, tmp_path):
    """However often results are read, a service is asked once for each row, and an engine's row is tried again once."""
    asked = f"{tmp_path}/asked"

    class Noted:
        def reply(self, model, system, user):
            with open(asked, "a") as f:
                f.write(user + "\n")
            return '{"x": 1}'

    df = spark.createDataFrame([("a",), ("bb",)], "prompt string")
    replies = adapters.chat(df, Noted(), "gpt-5", "sys")
    replies.count(), replies.collect()
    assert sorted(open(asked).read().split()) == ["a", "bb"]
    rows = adapters.chat_costs(replies, "s3_script", "openai", "gpt-5", F.col("prompt")).orderBy("note", "unit").collect()
    assert [(r.note, r.unit, r.quantity, r.usd) for r in rows] == [("a", "input_tokens", 4.0, 5e-6), ("a", "output_tokens", 7.0, 7e-5), ("bb", "input_tokens", 4.0, 5e-6), ("bb", "output_tokens", 7.0, 7e-5)]
    tries = f"{tmp_path}/tries"

    def again(failing):
        def call(batches):
            for b in batches:
                with open(tries, "a") as f:
                    f.writelines(f"{k}\n" for k in b["k"])
                kept = b[b["k"] != 4]
                yield kept.assign(x=kept["x"] - 4)

        return failing.mapInPandas(call, "k int, x int")

    rows = spark.createDataFrame([(1, 0), (2, 5), (3, 9), (4, 9), (5, 5)], "k int, x int")
    good, bad = engine.retried_once(rows, lambda df: df.withColumn("ok", F.col("x") < 3), again, ["k"])
    for _ in range(2):
        assert sorted(map(tuple, good.collect())) == [(1, 0), (2, 1), (5, 1)]
        assert sorted(map(tuple, bad.collect())) == [(3, 5), (4, 9)]
    assert sorted(open(tries).read().split()) == ["2", "3", "4", "5"]


def test_footage_speech_and_files(spark, tmp_path):
    asked = f"{tmp_path}/asked"

    def note(query):
        with open(asked, "a") as f:
            f.write(query + "|")

    service = adapters.CannedFootage({"old town": [{"id": 1}], "city": [{"id": 2}]}, note)
    kept = spark.createDataFrame([("sea", "", "[]")], adapters.FOUND).withColumn("name", cache.search_name(F.col("query")))
    queries = spark.createDataFrame([("  old   town",), ("old town",), ("",), (None,), ("sea",)], "query string")
    found, added = adapters.searched(queries, kept, service, "city")
    got = {(r.query, r.videos) for r in found.collect()}
    assert got == {("  old   town", '[{"id": 1}]'), ("old town", '[{"id": 1}]'), ("", '[{"id": 2}]'), (None, '[{"id": 2}]'), ("sea", "[]")}
    assert sorted(filter(None, open(asked).read().split("|"))) == ["city", "old town"] and added.count() == 2
    found, added = adapters.searched(queries, kept.unionByName(added), service, "city")
    assert added.count() == 0 and {(r.query, r.videos) for r in found.collect()} == got

    lines = spark.createDataFrame([("c", 0, "eight ch"), ("c", 1, "four")], "clip string, pos int, text string")
    said = adapters.spoken(lines, adapters.paced(), "out").orderBy("pos").collect()
    assert [(r.path, r.seconds) for r in said] == [("out/c_line_00.mp3", 2.0), ("out/c_line_01.mp3", 1.0)]
    start, end = timeline.running_spans(F.col("seconds"), 0.25, "clip", "pos")
    assert [(r.s, r.e) for r in adapters.spoken(lines, adapters.paced(), "out").select(start.alias("s"), end.alias("e")).orderBy("s").collect()] == [(0.0, 2.25), (2.25, 3.5)]
    with pytest.raises(Exception, match="no audio"):
        adapters.spoken(lines, lambda text, path: 0.0, "out")

    recordings = spark.createDataFrame([("v", "u")], "video_id string, url string")
    audio = adapters.downloaded(recordings, adapters.CannedAudio({"u"}), "w")
    assert adapters.probed(audio, lambda p: len(p), "audio_path").first().seconds == len("w/v/01_raw.m4a")
    with pytest.raises(Exception, match="no audio"):
        adapters.downloaded(recordings, adapters.CannedAudio(set()), "w")

    fetched = f"{tmp_path}/fetched"

    class Store:
        def fetch(self, link, path):
            with open(fetched, "a") as f:
                f.write(f"{link}>{path}\n")

    wanted = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, link string")
    clips = adapters.trimmed(wanted, spark.createDataFrame([("f/1_8s.mp4",)], "path string"), Store(), "f", 8.0)
    assert sorted(map(tuple, clips.collect())) == [(1, "f/1_8s.mp4"), (2, "f/2_8s.mp4")] and open(fetched).read() == "b>f/2_8s.mp4\n"

    base = f"{tmp_path}/shots"
    write(base, "a.json", {"key": "k1", "provider": "p"})
    write(base, "b.json", {"key": "k2"})
    write(base, "c.json", "{broken")
    for name in "abc":
        write(base, f"{name}.mp4", "film" if name != "b" else "x")
    side, files = documents.sidecars(spark, f"{base}/*.json"), documents.listing(spark, base, "*.mp4")
    names = files.select(F.concat_ws("/", "folder", "name").alias("path"))
    asked_for = spark.createDataFrame([(f"file:{base}/a.mp4", "k1"), (f"file:{base}/b.mp4", "other"), (f"file:{base}/c.mp4", "k3")], "path string, key string")
    same = lambda df: df.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    assert {(r.path[-5:], r.cached) for r in cache.sidecar_hits(same(asked_for), same(side), same(names)).collect()} == {("a.mp4", True), ("b.mp4", False), ("c.mp4", False)}
    assert documents.sidecars(spark, f"{base}/none/*.json").collect() == []
    ends = documents.listing_ends(files).first()
    assert (ends["first"], ends["last"]) == ("a.mp4", "c.mp4")


def test_engine(spark, tmp_path):
    setting = {"x": 1}
    calls = []

    def first(_):
        calls.append("first")
        return spark.range(3)

    def second(done):
        calls.append("second")
        return done["first"].withColumn("y", F.lit(setting["x"]))

    made = lambda **k: engine.Engine(spark, str(tmp_path), [engine.Stage("first", first, estimate=0.4, cost=lambda df: 0.3), engine.Stage("second", second, lambda: dict(setting), estimate=0.5, cost=lambda df: 0.2)], **k)
    e = made()
    assert e.run(dry_run=True) == {} and e.last_run["usd"] == pytest.approx(0.9) and calls == []
    assert e.run()["second"].count() == 3 and calls == ["first", "second"] and e.last_run["usd"] == 0.5
    e = made()
    e.run()
    assert e.last_run["stages_cached"] == ["first", "second"] and calls == ["first", "second"]
    setting["x"] = 2
    assert {r.y for r in e.run()["second"].collect()} == {2} and e.last_run["stages_cached"] == ["first"]
    e.run(until="first", force=True)
    assert list(e.record["stages"]) == ["first"]
    with pytest.raises(engine.BudgetExceeded):
        made(budget=0.7).run(force=True)
    assert len(made().record["runs"]) == 5


def test_costs_are_counted_while_written(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 3).alias("stage"), F.lit("openai").alias("provider"), (F.col("id") / 100).alias("usd"), (F.col("id") % 2 == 0).alias("estimated"))
    told = ledger.written(rows, f"{tmp_path}/ledger")
    assert told == {"spent_usd": 2500.0, "estimated_usd": 2495.0, "reference_usd": 0.0} and spark.read.parquet(f"{tmp_path}/ledger").count() == 1000
    opened = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            opened.add(b.num_rows)
            yield b

    once = rows.mapInArrow(seen, rows.schema)
    stage = engine.Stage("s3_script", lambda _: once, cost=F.sum(F.when(~F.col("estimated"), F.col("usd"))))
    run = engine.Engine(spark, f"file://{tmp_path}/run", [stage], budget=1e6)
    run.run()
    assert run.record["stages"]["s3_script"]["usd"] == 2500.0 and opened.value == 1000  # one pass writes and counts
    none = engine.Engine(spark, f"file://{tmp_path}/none", [engine.Stage("s3_script", lambda _: rows.limit(0), cost=F.sum("usd"))])
    none.run()
    assert none.record["stages"]["s3_script"]["usd"] == 0.0


def test_retry_and_lock(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (2, 5), (3, 9)], "k int, x int")
    check = lambda df: df.withColumn("ok", F.col("x") < 3)
    good, bad = engine.retried_once(rows, check, lambda df: df.withColumn("x", F.col("x") - 4), ["k"])
    assert sorted(r.k for r in good.collect()) == [1, 2] and [r.k for r in bad.collect()] == [3]
    with engine.Lock(str(tmp_path)) as lock:
        with pytest.raises(RuntimeError):
            engine.Lock(str(tmp_path)).__enter__()
        os.utime(lock.path, (0, time.time() - 4 * 3600))
        with engine.Lock(str(tmp_path)):
            pass
    with engine.Lock(str(tmp_path)):
        pass
    shared = f"file://{tmp_path}/shared"
    with engine.Lock(shared, spark) as lock:
        with pytest.raises(RuntimeError):
            engine.Lock(shared, spark).__enter__()
        os.utime(f"{tmp_path}/shared/.lock", (0, time.time() - 4 * 3600))
        with engine.Lock(shared, spark):
            pass
    with engine.Lock(shared, spark):
        pass


def test_stage_configurations():
    plain, fast = Settings.read({}), Settings.read({}, speedup=1.25)
    audio, other = (engine.config_hash(configs.download(x, "v")) for x in (plain, fast))
    assert audio != other and configs.download(plain, "v")["sample_rate"] == 16_000
    text = configs.transcribe(plain, "v", audio)
    assert engine.config_hash(text) != engine.config_hash(configs.transcribe(fast, "v", other))  # other audio, another transcript
    assert text["stt_model"] == "gpt-4o-mini-transcribe" and configs.transcribe(Settings.read({}, stt_provider="local"), "v", None)["stt_model"] == plain.local_stt_model


def test_engine_on_a_path_of_the_store(spark, tmp_path):
    """By a path that only Hadoop's file systems read."""
    said = []
    made = lambda: engine.Engine(spark, f"file://{tmp_path}/run", [engine.Stage("one", lambda _: spark.range(2))], log=said.append)
    made().run()
    e = made()
    e.run()
    assert e.last_run["stages_cached"] == ["one"] and len(e.record["runs"]) == 2 and said == ["one: done, 0.0000 dollars", "one: cached"]


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:10:00", ("a", "b")[i % 2], 0.25) for h in range(5) for i in range(4)]
    df = spark.createDataFrame(rows, "ts string, stage string, usd double").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("seq", F.monotonically_increasing_id())
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = stream.hourly(source, "ts").writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(60)
    done = {(r.hour.hour, r.stage): r.usd for r in spark.table("hours").collect()}
    assert done[(0, "a")] == 0.5 and len(done) >= 4
    q = stream.guarded(source.select("stage", "seq", "usd"), "stage", 1.0).writeStream.format("memory").queryName("guard").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("guard").groupBy("stage").agg(F.count_if("admitted").alias("n"), F.count("*").alias("all")).collect()
    assert {(r.stage, r.n, r["all"]) for r in got} == {("a", 4, 10), ("b", 4, 10)}


def test_sidecars_by_line(spark, tmp_path):
    """Many sidecars in a file, each with the path of what it stands beside; a broken line is left out, the rest of its file is kept."""
    write(f"{tmp_path}/lines", "a.json", {"path": "x/a.mp4", "key": "k1"})
    with open(f"{tmp_path}/lines/a.json", "a") as f:
        f.write('\n{broken\n{"path": "x/b.mp4", "key": "k2", "seed": 7}\n')
    side = documents.sidecars(spark, f"{tmp_path}/lines", by_line=True)
    assert sorted((r.path, r.key, r.seed) for r in side.collect()) == [("x/a.mp4", "k1", None), ("x/b.mp4", "k2", 7)]
    assert documents.sidecars(spark, f"{tmp_path}/none", by_line=True).columns == side.columns


def test_sidecars_take_no_file_for_each_shot(spark, tmp_path, monkeypatch):
    """The query's files don't grow in number with the shots."""
    monkeypatch.setattr(queries, "new_folder", lambda spark, kind: f"{tmp_path}/{kind}")
    shots = queries.s9_h2_sidecars(spark, "/root/testdata/sf0.01").count()
    assert shots == 100 and len(glob.glob(f"{tmp_path}/shots/**/part-*", recursive=True)) < 20


def test_manifests_are_stored_compressed(spark, tmp_path, monkeypatch):
    """The overview's ledger lines go through one exchange, and what it stores takes less than a third of its plain size."""
    monkeypatch.setattr(queries, "new_folder", lambda spark, kind: f"{tmp_path}/{kind}")
    assert queries.s3_a4_a5_a7_overview(spark, "/root/testdata/sf0.01").count() == 14_743
    files = glob.glob(f"{tmp_path}/manifests/part-*")
    plain = spark.read.text(f"{tmp_path}/manifests").agg(F.sum(F.octet_length("value"))).first()[0]
    assert files and sum(map(os.path.getsize, files)) < plain / 3
