"""Known values of text, numeral, coercion, gate, timeline and ledger operators."""

import random
import time

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift import storage
from spindrift.functions import coerce, numerals, text
from spindrift.operators import cache, choose, gate, ledger, overlap, provenance, replies, timeline
from spindrift.plans import queries


def one(spark, column, **values):
    """A column's value over one row of the given values."""
    names = list(values) or ["x"]
    row = [tuple(v[0] for v in values.values()) or (1,)]
    return spark.createDataFrame(row, ", ".join(f"`{n}` {values[n][1]}" for n in values) or "x int").select(column.alias("out")).first()[0]


# text


@pytest.mark.parametrize(("a", "b", "n"), [("abc房價所得比xyz", "qq房價所得比zz", 5), ("房價，所得 比", "房價所得比", 5), ("", "abc", 0)])
def test_longest_shared(spark, a, b, n):
    df = spark.createDataFrame([(1, a, b)], "k int, text string, source string")
    assert overlap.longest_shared(df, "k").first().lcs == n


def test_shared_text_and_overlap(spark):
    df = spark.createDataFrame([(1, "xx台北市15.7倍yy", "台北市15.7倍"), (2, "短", "很長的文字在這裡"), (3, "很長的文字在這裡", "前面很長的文字在這裡"), (4, "abcdefgh", "zyxwvuts"), (5, None, None)], "k int, text string, source string")
    assert {r.k: r.shared for r in overlap.longest_shared(df, "k").collect()}[1] == "台北市157倍"
    share = {r.k: r.overlap for r in overlap.gram_share(df, "k", 6).collect()}
    assert (share[2], share[3], share[4], share[5]) == (0.0, 1.0, 0.0, 0.0)
    again = {r.k: r.o for r in df.select("k", text.gram_overlap(F.col("text"), F.col("source"), 6).alias("o")).collect()}
    assert share == again
    gated = {r.k: r.ok for r in overlap.gated(df, "k").collect()}
    column = {r.k: r.o.ok for r in df.select("k", text.originality(F.col("text"), F.col("source")).alias("o")).collect()}
    assert gated == column and gated[3] is False and gated[4] is True
    with pytest.raises(ValueError):
        text.grams(F.lit("x"), 0)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=12), st.text("ab", max_size=12))
def test_shared_is_longest_and_earliest(a, b):
    every = [(i, j) for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b]
    want = min(every, key=lambda x: (x[0] - x[1], x[1]), default=(0, 0))
    assert text.shared(a, b) == a[want[0] : want[1]]


def test_video_ids(spark):
    good = ["https://x/watch?v=dQw4w9WgXcQ&t=1", "https://youtu.be/dQw4w9WgXcQ", "https://x/shorts/dQw4w9WgXcQ", "https://x/embed/dQw4w9WgXcQ?x", "dQw4w9WgXcQ"]
    df = spark.createDataFrame([(u,) for u in [*good, "nothing", None]], "u string")
    assert [r[0] for r in df.select(text.video_id(F.col("u"))).collect()] == ["dQw4w9WgXcQ"] * 5 + [None, None]


def test_wrap_keeps_closing_marks_off_line_starts(spark):
    assert one(spark, text.wrap(F.col("t"), 10), t=("一二三四五六七八九十，十一十二", "string")) == ["一二三四五六七八九十，", "十一十二"]
    assert one(spark, text.wrap(F.col("t"), 5), t=("ab\n\ncdefgh", "string")) == ["ab", "", "cdefg", "h"]


def test_small_text_functions(spark):
    assert one(spark, text.clock(F.col("s")), s=(3725.9, "double")) == "62:05"
    assert one(spark, text.clock(F.col("s")), s=(-3.0, "double")) == "00:00"
    assert one(spark, text.sentences(F.col("t")), t=("你好。今天很好！再見？", "string")) == ["你好。", "今天很好！", "再見？"]
    assert one(spark, text.collapse(F.col("t"), "city"), t=(" \n ", "string")) == "city"
    assert one(spark, text.csv_items(F.col("t")), t=("HF, comfy,,", "string")) == ["hf", "comfy"]
    assert one(spark, text.strip_markup(F.col("t")), t=("[bold red]x[/] [y]", "string")) == "x [y]"


# numerals

STATED = [("一萬五", 15000), ("1萬5", 15000), ("1.5萬", 15000), ("五千八百億", 5.8e11), ("四十年", 40), ("百分之四十", 40), ("四成", 40), ("兩千三百八十萬", 23800000), ("2,380萬", 23800000), ("三點五", 3.5), ("九字頭", 90), ("豪宅70到80萬/坪", 700000), ("三百零五", 350), ("一千零五", 1500), ("二〇二五", 5), ("重點", 0), ("１２３", 123)]


@pytest.mark.parametrize(("said", "value"), STATED)
def test_stated_values(said, value):
    assert value in {v for _, vals in numerals.stated(said) for v in vals}


def test_tokens():
    assert numerals.stated("三萬二三萬四") == [("三萬二三萬四", [32000.0, 34000.0])]
    assert [t for t, _ in numerals.stated("5800億2025縮到4100多億")] == ["5800億", "2025", "4100"]
    assert numerals.stated("") == [] and numerals.stated("萬億") == [] and numerals.stated("四成本") == [("四", [4.0])]


@pytest.mark.parametrize(("raw", "said"), [("1e+07元", "1000萬元"), ("23800000", "2380萬"), ("400000", "40萬"), ("580000000000", "5800億"), ("15000", "15000"), ("123456789", "1.23457億"), ("99999", "99999"), ("123456", "12.3456萬"), ("3e9999", "3e9999"), ("1e400", "1e400")])
def test_humanised(raw, said):
    assert numerals.humanised(raw) == said


def test_number_columns_and_sql(spark):
    df = spark.createDataFrame([(1, "一萬五 和 8.5"), (2, None)], "k int, t string")
    rows = df.select("k", numerals.values(numerals.number_tokens("t")).alias("v")).collect()
    assert rows[0].v == [15000.0, 8.5] and rows[1].v == []
    numerals.register(spark)
    df.createOrReplaceTempView("said")
    got = spark.sql("SELECT k, tok FROM said, LATERAL number_tokens(t)").collect()
    assert sorted((r.k, r.tok) for r in got) == [(1, "8.5"), (1, "一萬五")]
    assert spark.sql("SELECT humanize_numbers('400000')").first()[0] == "40萬"
    left = df.select(numerals.unstated(numerals.number_tokens("t"), F.array(F.lit(15010.0)), F.array(F.lit(99.0))).alias("u")).collect()
    assert [r.u for r in left] == [["8.5"], []]
    assert one(spark, numerals.label(F.col("v"), F.lit("元")), v=(2380.0, "double")) == "2,380元"
    assert one(spark, numerals.label(F.col("v"), F.lit("倍")), v=(15.7, "double")) == "15.7倍"


# tolerance joins


def test_stated_join_is_the_band_join(spark):
    rng = random.Random(3)
    values = [(i % 5, x) for i in range(300) for x in [rng.choice([0.0, 1e-7, -1e-4, 2e-4, 2.1e-4, 1.0, -3.5, 1e6]) * (1 + rng.uniform(-0.01, 0.01)) + rng.choice([0, 5e-7])]]
    source = [(i % 5, x) for i in range(60) for x in [rng.choice([0.0, 1e-7, -1e-4, 2e-4, 2.1e-4, 1.0, -3.5, 1e6]) * (1 + rng.uniform(-0.01, 0.01))]]
    got = provenance.stated(spark.createDataFrame(values, "k int, value double"), spark.createDataFrame(source, "k int, value double"), ["k"]).collect()
    want = [(k, v) for k, v in values if any(k == j and abs(s - v) <= max(1e-6, 0.005 * abs(v)) for j, s in source)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_checked_chart(spark):
    points = spark.createDataFrame([(1, "a", 0, "台北", 15.7, "倍"), (1, "a", 1, "桃園", 8.5, "倍"), (1, "a", 2, "新北", 12.0, "倍"), (1, "b", 0, "x", 99.0, ""), (1, "b", 1, "y", 12.0, ""), (2, "a", 0, "p", 3.6, "萬"), (2, "a", 1, "q", 5800.0, "億")], "clip int, series string, pos int, label string, value double, unit string")
    source = spark.createDataFrame([(1, 15.7), (1, 12.0), (2, 36000.0), (2, 5.8e11)], "clip int, value double")
    kept = provenance.checked_chart(points, source, "clip")
    assert sorted((r.clip, r.series, r.label) for r in kept.collect()) == [(1, "a", "台北"), (1, "a", "新北"), (2, "a", "p"), (2, "a", "q")]
    nested = {r.clip: r.series for r in provenance.nested_chart(kept, "clip").collect()}
    assert [p.label for p in nested[1][0].points] == ["台北", "新北"]
    flags = one(spark, provenance.spoken(F.col("t"), F.col("a"), F.array(F.lit(15.7))), t=("15.7 倍 兩百萬 8.5 來源3台", "string"), a=("來源3台", "string"))
    assert flags == ["text:兩百萬", "text:8.5"]


# coercion


@pytest.mark.parametrize(("raw", "value"), [("1,234.5", 1234.5), ("45%", 45.0), ("1:30", 90.0), ("1:02:03", 3723.0), ("12d", 0.0), ("x", 0.0), (None, 0.0), ("-2e3", -2000.0), ("", 0.0)])
def test_as_double(spark, raw, value):
    assert one(spark, coerce.as_double(F.col("r")), r=(raw, "string")) == value


def test_other_coercions(spark):
    assert one(spark, coerce.as_int(F.col("r"), 7), r=("2.5", "string")) == 2 and one(spark, coerce.as_int(F.col("r"), 7), r=("no", "string")) == 7
    assert one(spark, coerce.as_bool(F.col("r")), r=(" 是 ", "string")) is True and one(spark, coerce.as_bool(F.col("r")), r=(None, "string")) is False
    raw = [("a", "1,000", None), ("b", "many", "x"), (None, "5%", "y")]
    got = one(spark, coerce.points(F.col("p")), p=(raw, "array<struct<label:string,value:string,unit:string>>"))
    assert [tuple(p) for p in got] == [("a", 1000.0, ""), ("", 5.0, "y")]


# gate


def test_selection(spark):
    rows = [
        (1, 0, 1, 0.0, 50.0, "房價所得比創新高", "台北房價所得比", True, 5, [(15.7, "倍"), (16.0, "倍")]),
        (1, 1, 2, 60.0, 100.0, "完全不同的話題", "健康飲食與運動", True, 2, []),
        (1, 2, 3, 110.0, 150.0, "房價所得比創新高", "台北房價所得比", True, 4, []),
        (1, 3, 4, 160.0, 200.0, "蔬菜水果", "維他命的來源", True, 4, [(15.7, "倍"), (16.0, "倍"), (1.0, "")]),
        (1, 4, 5, 10.0, 45.0, "睡眠品質", "失眠的改善", True, 3, []),
        (1, 5, 6, 210.0, 250.0, "手機電池", "快充的影響", False, 5, []),
        (1, 6, 7, 260.0, 300.0, "咖啡因", "提神與心悸", False, 4, []),
        (1, 7, 8, 310.0, 350.0, "登山裝備", "冬季的準備", False, 3, []),
        (2, 0, 1, 0.0, 50.0, "房價所得比創新高", "台北房價所得比", False, 3, []),
    ]
    df = spark.createDataFrame(rows, "video int, pos bigint, id int, start double, end double, topic string, summary string, has_chart_data boolean, hook_score int, data_points array<struct<value:double,unit:string>>")
    got = {(r.video, r.id): r.skip_reason for r in gate.select(df, "video").collect()}
    assert got == {(1, 1): "", (1, 2): "hook_score 2 < threshold 3", (1, 3): "duplicate of segment 1 (text similarity)", (1, 4): "duplicate of segment 1 (same figures)", (1, 5): "duplicate of segment 1 (time overlap)", (1, 6): "", (1, 7): "", (1, 8): "over max_clips budget", (2, 1): ""}


def test_ids_and_units(spark):
    assert one(spark, gate.unique_ids(F.col("x")), x=([3, 3, 1, 4, 1], "array<bigint>")) == [3, 4, 1, 5, 6]
    df = spark.createDataFrame([(1, 0, 1.0, "萬/坪"), (1, 1, 2.0, "萬"), (1, 2, 3.0, "萬/坪"), (2, 0, 1.0, "a"), (2, 1, 1.0, "b"), (3, 0, 1.0, "a")], "k int, pos int, value double, unit string")
    assert sorted((r.k, r.pos) for r in gate.major_unit(df, ["k"]).collect()) == [(1, 0), (1, 2), (3, 0)]


def test_near_pairs_lose_none(spark):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcd", k=12)) for _ in range(6)]
    rows = [(i % 3, i, "".join(c if rng.random() > 0.15 else "z" for c in rng.choice(base))) for i in range(60)]
    got = {(r.k, r.a, r.b) for r in gate.near_pairs(spark.createDataFrame(rows, "k int, id int, text string"), "k").collect()}
    sets = {i: {t[j : j + 2] for j in range(len(t) - 1)} for _, i, t in rows}
    want = {(k, i, j) for k, i, _ in rows for m, j, _ in rows if k == m and i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5}
    assert got == want


# timelines


def test_timings_and_windows(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0)], "k int, i int, d double")
    start, end = timeline.running_spans(F.col("d"), 0.25, "k", "i")
    assert [tuple(r) for r in df.select(start, end).collect()] == [(0.0, 1.25), (1.25, 3.5)]
    lines = spark.createDataFrame([(1, i, 2.0 * i, 2.0 * i + 2, 8.0) for i in range(4)], "k int, pos int, start double, end double, total double")
    for n, want in ((1, [(0.0, 9.0)]), (2, [(0.0, 2.0), (2.0, 9.0)]), (3, [(0.0, 2.0), (2.0, 4.0), (4.0, 9.0)]), (10, [(0.0, 2.0), (2.0, 4.0), (4.0, 6.0), (6.0, 9.0)])):
        got = sorted((r.scene, r.start, r.end) for r in timeline.scenes(lines, "k", F.lit(n)).collect())
        assert [g[1:] for g in got] == want


def test_buckets_are_even_runs(spark):
    rows = [(i, n, m) for n in range(1, 30) for m in range(1, n + 1) for i in range(n)]
    got = spark.createDataFrame(rows, "i int, n int, m int").select("i", "n", "m", timeline.bucket_of(F.col("i"), F.col("n"), F.col("m")).alias("b")).collect()
    assert all(r.b * r.n // r.m <= r.i < (r.b + 1) * r.n // r.m for r in got)


def test_phrases(spark):
    assert one(spark, timeline.phrases(F.col("t")), t=("你好。今天很好！再見？", "string")) == ["你好。", "今天很好！", "再見？"]
    assert one(spark, timeline.phrases(F.col("t"), 5), t=("ab cd ef\tg。", "string")) == ["abcd", "efg。"]
    df = spark.createDataFrame([(1, 0, 3), (1, 1, 5), (1, 2, 2)], "k int, i int, n int")
    start, end = timeline.allocated(F.col("n"), F.lit(10.0), F.lit(20.0), "k", "i")
    rows = [tuple(r) for r in df.select(start, end).collect()]
    assert rows[0][0] == 10.0 and rows[-1][1] == 20.0 and rows[0][1] == rows[1][0]


def test_overlaps_once(spark):
    rng = random.Random(6)
    spans = [(1, i, a, a + rng.uniform(0, 200)) for i in range(30) for a in [rng.uniform(0, 500)]]
    segs = [(1, i, a, a + rng.uniform(0, 130), "t") for i in range(80) for a in [rng.uniform(-50, 600)]]
    for pad in (0.0, 20.0):
        got = timeline.overlaps(spark.createDataFrame(spans, "k int, span_id int, lo double, hi double"), spark.createDataFrame(segs, "k int, pos int, start double, end double, text string"), "k", pad).collect()
        want = sorted((s[1], g[1]) for s in spans for g in segs if g[3] > s[2] - pad and g[2] < s[3] + pad)
        assert sorted((r.span_id, r.pos) for r in got) == want


# ledger


def test_rollups(spark):
    rows = [("v", "s2_transcribe", "openai", "m", 0.017, False, None), ("v", "s3_script", "openai", "gpt-5", 0.03, False, "pass_b #1"), ("v", "s3_script", "openai", "gpt-5-mini", 0.012, False, "Pass A"), ("v", "s3_script", "openai", "gpt-5", 0.999, True, "pass b"), ("v", "s4_render", "reference", "api", 15.0, True, "")]
    df = spark.createDataFrame(rows, "video string, stage string, provider string, model string, usd double, estimated boolean, note string")
    r = ledger.rollup(df, []).first()
    assert (r.spent_usd, r.estimated_usd, r.reference_usd) == (0.059, 0.999, 15.0)
    stages = ledger.by_stage(df, df, "video")
    assert stages.count() == 4
    runs = spark.createDataFrame([("v", 1, ["s2_transcribe"]), ("v", 2, ["s3_script", "s3_script", "s1_download"])], "video string, run int, stages_cached array<string>")
    assert ledger.saved_by_cache(stages, runs, "video").first().saved_usd == 0.042
    segments = spark.createDataFrame([("v", True), ("v", False), ("v", False)], "video string, selected boolean")
    assert ledger.naive_alternative(df, segments, "video", "gpt-5").first().naive_usd == 15.09


def test_costs(spark):
    usage = spark.createDataFrame([("s3", "openai", "gpt-5-mini", 1_000_000, 100_000, False, "n"), ("s3", "who", "knows", 5, 5, False, "n")], "stage string, provider string, model string, input_tokens long, output_tokens long, estimated boolean, note string")
    assert sorted(r.usd for r in ledger.llm_rows(usage).collect()) == [0.0, 0.0, 0.2, 0.25]
    stt = spark.createDataFrame([("s2", "openai", "gpt-4o-mini-transcribe", 600.0, False)], "stage string, provider string, model string, seconds double, estimated boolean")
    assert ledger.stt_rows(stt).first().usd == 0.03
    tts = spark.createDataFrame([("s4", "openai", "gpt-4o-mini-tts", 1000, False)], "stage string, provider string, model string, characters long, estimated boolean")
    assert ledger.tts_rows(tts).first().usd == 0.0486
    assert ledger.reference_rows(spark.createDataFrame([(110.1,)], "seconds double")).first().usd == 27.525
    with pytest.raises(Exception, match="no price for"):
        ledger.strictly_priced(spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("b", 1.0)], "k string, price double"), ["k"], "price").collect()
    assert [one(spark, ledger.frames(F.col("s")), s=(s, "double")) for s in (5.0, 2.0, 0.1)] == [121, 49, 9]
    chain = spark.createDataFrame([(1, 0, "a", 0.1), (1, 1, "b", 0.81), (1, 2, "c", 0.81)], "k int, pos int, provider string, usd double")
    assert ledger.worst_provider(chain, "k").first().provider == "b"


def test_budget(spark):
    calls = spark.createDataFrame([(1, 0, 0.5, 0.5), (1, 1, 0.5, 0.4), (1, 2, 0.2, 0.0), (1, 3, 0.05, 0.05)], "k int, i int, estimate double, actual double")
    assert [r.admitted for r in ledger.budget_guard(calls, "k", "i", 1.0).orderBy("i").collect()] == [True, True, False, False]


# choices and state


def test_rendition(spark):
    kind = "array<struct<width:int,height:int,file_type:string,link:string>>"
    files = [(2160, 3840, "video/mp4", "4k"), (1080, 1920, "video/mp4", "hd"), (1920, 1080, "video/mp4", "land"), (540, 960, "video/mp4", "sd"), (1080, 1920, "video/webm", "webm")]
    pick = choose.rendition(F.col("f"))
    assert one(spark, pick, f=(files, kind)).link == "hd"
    assert one(spark, pick, f=([files[2], files[4]], kind)).link == "land"
    assert one(spark, pick, f=([files[3], (360, 640, "video/mp4", "tiny")], kind)).link == "sd"
    assert one(spark, pick, f=([files[4]], kind)) is None


def test_attribution(spark):
    put = choose.with_attribution(F.col("x"), F.lit("src"))
    assert [one(spark, put, x=(x, "array<string>")) for x in (["a", "b"], [], ["a src"], ["a"])] == [["a", "src", "b"], ["src"], ["a src"], ["a", "src"]]


def test_config_hash(spark):
    from spindrift.plans.engine import config_hash

    config = {"b": 'quote " and \\ and\n', "a": "中文", "n": None}
    made = F.create_map(F.lit("b"), cache.quoted(F.lit(config["b"])), F.lit("n"), F.lit(None).cast("string"), F.lit("a"), cache.quoted(F.lit(config["a"])))
    assert one(spark, cache.config_hash(made)) == config_hash(config)


def test_state(spark):
    kept = spark.createDataFrame([(1, "s1_download"), (1, "s3_script"), (1, "s4_render"), (2, "s3_script")], "v int, stage string")
    gone = cache.invalidated(kept, spark.createDataFrame([(1, "s3_script")], "v int, stage string"), "v")
    assert sorted(map(tuple, gone.collect())) == [(1, "s1_download"), (2, "s3_script")]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, x string")
    for out in (cache.upserted(old, new, ["k"]), cache.merged(old, new, "k", "x")):
        assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert one(spark, cache.reached(F.col("s"), "s2"), s=("s3_script", "string")) is False


def test_settings_and_names(spark):
    from spindrift.settings import Settings
    from spindrift.sources import adapters, documents

    made = Settings.read({"SPINDRIFT_MAX_CLIPS": "5", "SPINDRIFT_REMOVE_SILENCE": "no"}, speedup=1.5)
    assert (made.max_clips, made.remove_silence, made.speedup, made.speech_model()) == (5, False, 1.5, ("edge", "edge-tts"))
    known, wanted = spark.createDataFrame([("demo",)], "name string"), spark.createDataFrame([("demo",), ("https://youtu.be/dQw4w9WgXcQ",)], "name string")
    assert sorted(r.folder for r in documents.resolved(wanted, known).collect()) == ["dQw4w9WgXcQ", "demo"]
    with pytest.raises(Exception, match="neither"):
        documents.resolved(spark.createDataFrame([("what",)], "name string"), known).collect()
    assert one(spark, adapters.converted(F.col("t"), {"国": "國"}), t=(" 中国 ", "string")) == "中國"
    assert one(spark, F.length(documents.now())) == 19
    assert ledger.footage_rows(spark.createDataFrame([("p", 3, False)], "provider string, n int, estimated boolean")).first().usd == 0.0


# replies


def parsed(spark, fold, **columns):
    """One reply through a parser."""
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} {'boolean' if isinstance(v, bool) else 'string'}" for n, v in columns.items()))
    return fold(row).first()


def test_candidates_of_unknown_make(spark):
    reply = """```json
    {"segments": [
      {"id": 3, "start": "1:05", "end": "1:00:00", "topic": "  one\u3000", "summary": 5, "key_points": ["a", "", 7, null], "data_points": [{"label": "p", "value": "1,5%", "unit": null}, {"label": "q", "value": 2.5, "unit": "x"}, {"value": "n/a"}, {"value": null}, "junk"], "has_chart_data": "YES", "hook_score": 9},
      "junk", 5, null, [1], {"id": "x", "topic": "", "hook_score": "high"},
      {"id": 3, "start": 1, "end": 2, "topic": "again", "hook_score": "2.5", "has_chart_data": true, "data_points": [{"value": 1}]},
      {"id": null, "start": 5, "end": "bad", "topic": "ends before it starts"},
      {"start": true, "end": 3, "topic": "no id", "key_points": "alone", "hook_score": -4}
    ]}
    ```"""
    found = parsed(spark, replies.candidates, reply=reply).segments
    assert [(s.id, s.start, s.end, s.topic, s.summary) for s in found] == [(3, 65.0, 3600.0, "one", "5"), (4, 1.0, 2.0, "again", ""), (9, 0.0, 3.0, "no id", "")]
    assert [s.key_points for s in found] == [["a", "7", "None"], [], ["alone"]]
    assert [[tuple(p) for p in s.data_points] for s in found] == [[("p", 15.0, ""), ("q", 2.5, "x")], [("", 1.0, "")], []]
    assert [(s.has_chart_data, s.hook_score) for s in found] == [(True, 5), (False, 2), (False, 1)]
    for empty in (None, "", "no JSON", "[]", "{}", '{"segments": {"a": 1}}', '{"segments": null}'):
        assert parsed(spark, replies.candidates, reply=empty).segments == []


def script_of(spark, reply, topic="標題", chart=True):
    return parsed(spark, replies.scripts, reply=reply, topic=topic, has_chart_data=chart, attribution="根據X報導指出").script


def test_scripts_of_unknown_make(spark):
    assert script_of(spark, None) is None and script_of(spark, "[1]") is None and script_of(spark, "{broken") is None
    bare = script_of(spark, "{}")
    assert (bare.title, bare.hook, [x.text for x in bare.lines], bare.chart, bare.est_seconds, bare.ai_shot) == ("標題", "", ["根據X報導指出"], None, 30.0, "")
    full = script_of(spark, '{"title": "  月付1e+07 ", "hook": "房價，漲了 3%", "lines": ["房價漲了3%", {"text": " 23800000元 ", "emphasis": "是", "visual": " city "}, "", 7, {"text": null}, "根據X報導指出，完"], "est_seconds": 0, "ai_shot": null, "chart": {"type": "Line", "title": null, "series": [{"name": "s", "points": [{"value": 1, "unit": "倍"}, {"value": 2, "unit": "元"}, {"value": 3, "unit": "倍"}]}, {"points": [{"value": 1, "unit": "a"}, {"value": 1, "unit": "b"}]}, {"name": "one", "points": [{"value": "9"}]}]}}')
    assert (full.title, full.hook, full.est_seconds, full.ai_shot) == ("月付1000萬", "房價，漲了 3%", 30.0, "")
    assert [tuple(x) for x in full.lines] == [("2380萬元", True, "city"), ("根據X報導指出，完", False, "")]  # the first line said the hook again
    assert (full.chart.type, full.chart.title, full.chart.y_label) == ("line", "標題", "")
    assert [(x.name, [p.value for p in x.points]) for x in full.chart.series] == [("s", [1.0, 3.0]), ("one", [9.0])]
    assert script_of(spark, '{"lines": ["a", "b"], "chart": {"series": [{"points": [{"value": 1}]}]}}', chart=False).chart is None
    short = script_of(spark, '{"lines": ["一", "二", "三"], "est_seconds": "1:05", "chart": {"type": "pie", "series": []}}')
    assert (short.hook, [x.text for x in short.lines], short.est_seconds, short.chart) == ("一", ["二", "根據X報導指出", "三"], 65.0, None)


def test_prompt_and_basis(spark):
    df = spark.createDataFrame([(1, 785.0, 3725.0, "t", "s", [], [("台北市", 15.7, "倍"), ("x", 1e7, "元"), ("y", 1.5e-7, "")], True)], "id int, start double, end double, topic string, summary string, key_points array<string>, data_points array<struct<label:string,value:double,unit:string>>, has_chart_data boolean")
    said = df.select(replies.script_prompt(F.struct(*df.columns), F.lit("原文"), F.lit("出處"))).first()[0]
    assert said.split("\n") == ["segment_id: 1", "topic: t", "summary: s", "has_chart_data: true", "出處句（必須完整出現在第 1 或第 2 句）：出處", "", "key_points:", "- （無）", "", "data_points（數字只能用這些，或逐字稿裡出現的）:", "- 台北市: 15.7倍", "- x: 1e+07元", "- y: 1.5e-07", "", "原始逐字稿片段（13:05–62:05，只供了解事實，禁止照抄）：", "原文"]
    cases = [("abc", None, 3, "transcript"), (None, {"chars": 5.9, "duration_sec": 9.0}, 5, "chars"), (None, {"chars": 0.0, "seconds_billed": 2.6}, 10, "seconds_billed x 4.0 chars/s"), (None, {}, 3000, "assumed"), (None, None, 3000, "assumed")]
    rows = spark.createDataFrame([(i, t, m) for i, (t, m, _, _) in enumerate(cases)], "i int, t string, m map<string,double>")
    got = rows.select("i", *replies.estimate_basis(F.col("t"), F.col("m"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [c[2:] for c in cases]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=40))
def test_general_is_six_digits(spark_values):
    from pyspark.sql import SparkSession

    values = spark_values + [0.0, 1e-4, 9.99999e-5, 0.5, 999.9996, 99999.949, 999999.4, 1e6, -2.5e-9, 123456.5]
    df = SparkSession.getActiveSession().createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", numerals.general(F.col("v")).alias("g")).collect():
        assert float(r.g) == pytest.approx(float(f"{r.v:g}"), rel=2e-6, abs=1e-300) and len(r.g) <= len(f"{r.v:g}") + 4


def test_source_names_and_small_operators(spark):
    names = [("HEALTH 2.0 健康", "TVBS《健康2.0》"), ("健康2.0", "TVBS《健康2.0》"), ("頻道", "頻道"), ("", "原始節目"), (None, "原始節目")]
    df = spark.createDataFrame([(c,) for c, _ in names], "c string")
    assert [r[0] for r in df.select(text.source_name(F.col("c"))).collect()] == [n for _, n in names]
    assert one(spark, text.attribution(F.col("s")), s=("X", "string")) == "根據X報導指出"
    numerals.register(spark)
    assert spark.sql("SELECT lcs_len('xx台北市，15.7倍', '台北市15.7倍yy'), lcs_text('abc', 'zbcz'), lcs_len(NULL, 'a')").first()[:] == (7, "bc", 0)
    known = spark.createDataFrame([("v", 0.0, 950.0), ("w", 800.0, 950.0)], "n string, p double, o double")
    assert [r[0] for r in known.select(timeline.processed_or_known(F.col("p"), F.col("o"), F.col("n"))).collect()] == [950.0, 800.0]
    with pytest.raises(Exception, match="no duration"):
        known.select(timeline.processed_or_known(F.lit(0.0), F.lit(None).cast("double"), F.col("n"))).collect()


def test_shared_is_linear_in_memory():
    import tracemalloc

    rng = random.Random(5)
    a, b = ("".join(rng.choices("abcd", k=60_000)) for _ in range(2))
    b = b[:30_000] + a[20_000:20_500] + b[30_000:]
    tracemalloc.start()
    assert text.shared(a, b).find(a[20_000:20_500]) >= 0
    assert tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()


def test_number_tokens_go_back_in_pieces(spark, tmp_path):
    """What a worker holds of a batch's tokens is bounded, however many figures its texts hold; rows keep their places."""
    said = [" ".join(str(i + k) for k in range(900)) if i % 3 else None if i % 2 else "no figures" for i in range(300)]
    pieces = list(numerals.number_tokens.func(iter([pd.Series(said[:200]), pd.Series(said[200:])])))
    assert max(piece.map(len).sum() for piece in pieces) < 10_900
    assert [[(t["tok"], t["vals"]) for t in row] for piece in pieces for row in piece] == [numerals.stated(x or "") for x in said]
    spark.createDataFrame(list(enumerate(said[:60])), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.n6_n7_number_tokens(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.pos, r.tok, r.vals) for r in rows) == [(i, k, str(i + k), [float(i + k)]) for i in range(60) if i % 3 for k in range(900)]


def test_texts_come_in_short_batches(spark, tmp_path):
    """What one Arrow batch of texts carries to Python is bounded by its bytes, so a worker's memory doesn't grow with the table; short rows stay many to a batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    @F.pandas_udf("long")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    @F.pandas_udf("long")
    def rows(ids: pd.Series) -> pd.Series:
        return pd.Series([len(ids)] * len(ids))

    spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 5000).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    try:
        texts = queries.texts(spark, str(tmp_path)).coalesce(1)
        assert texts.select(held("text").alias("n")).agg(F.max("n"), F.count("*")).first() == (pytest.approx(storage.BATCH_BYTES, abs=storage.BATCH_BYTES // 2), 4000)
        assert spark.range(20_000).coalesce(1).select(rows("id").alias("n")).agg(F.max("n")).first()[0] == 10_000
        spark.conf.set(name, "1m")
        storage.short_batches(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_phrases_of_a_long_sentence(spark):
    """Time grows with the text, not with its length times its phrases."""
    text = spark.createDataFrame([("word " * 200_000,)], "t string")
    begun = time.time()
    found = text.select(timeline.phrases(F.col("t")).alias("p")).select(F.size("p"), F.element_at("p", 1), F.element_at("p", -1)).first()
    assert tuple(found) == (28_572, "word" * 7, "word" * 3) and time.time() - begun < 30
    assert one(spark, timeline.phrases(F.col("t"), 5), t=("abcdefgh ij k。l 。mn", "string")) == ["abcdefgh", "ijk。", "l。", "mn"]
