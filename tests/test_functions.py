import datetime

import pytest
from pyspark.sql import functions as F

from tidings.functions import similarity as s
from tidings.functions import text as x
from tidings.functions import values as v
from tidings.operators import details, folds, records, relevance, resolution
from tidings.sources import cursor, html_cards, tables


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_normalizers(spark):
    lit = F.lit
    assert one(spark, x.normalize_arabic(lit("  «مَدْرَسـة»، ")), x.normalize_arabic(lit("أحمد  إلى آخر،")), x.normalize_arabic(lit(None).cast("string"))) == ("«مدرسه»", "احمد الى اخر", None)
    assert one(spark, x.normalize_english(lit("  (Bint  Jbeil), "))) == ("bint jbeil",)
    assert one(spark, x.fold_alert(lit("مُسَيَّرة_على  بيروت!!"))) == ("مسيره علي بيروت",)
    assert one(spark, x.latin_token(lit("Château-Chîh 3")), x.strip_emoji(lit("a🚨b☀️c"))) == ("shateaushih", "abc")
    assert one(spark, x.valid_text(lit("نص ok")), x.valid_text(lit("نصok")), x.valid_text(lit("é")), x.valid_text(lit("  "))) == (True, False, False, False)
    assert one(spark, x.is_boilerplate(lit("الخريطة JM"), ["الخريطة"]), x.is_boilerplate(lit("الخريطة هنا"), ["الخريطة"])) == (True, False)
    assert one(spark, x.id_prefix(lit("telegram:7")), x.id_prefix(lit("7")), x.id_prefix(lit(":7"))) == ("telegram", None, None)
    assert one(spark, x.initcap_words(lit("foo-bar BAZ2x"))) == ("Foo-Bar Baz2x",)


def test_similarities(spark):
    a, b = F.lit("word"), F.lit("two words")
    got = one(spark, s.similarity(a, b), s.word_similarity(a, b), s.word_similarity(b, a), s.similarity(F.lit("--"), F.lit("")))
    assert got == pytest.approx((0.363636, 0.8, 0.4, 0.0), abs=1e-6)
    arr = lambda *y: F.array(*map(F.lit, y))
    assert one(spark, s.cosine(arr(1.0, 0.0), arr(1.0, 1.0)), s.cosine(arr(0.0), arr(1.0)), s.cosine(F.lit(None).cast("array<double>"), arr(1.0))) == pytest.approx((0.70710678, 0.0, 0.0))


def test_values(spark):
    n = F.lit(None).cast("int")
    assert one(spark, v.null_sum(n, F.lit(2)), v.null_sum(n, n), v.true_count(F.lit(False), F.lit(True)), v.true_count(F.lit(False))) == (2, None, 1, None)
    assert one(spark, *v.coerce_int(F.lit("7.0")), *v.coerce_int(F.lit("7.5"))) == (7, None, None, "not a whole number: 7.5")
    assert one(spark, *v.coerce_count(F.lit("-1")), *v.coerce_flag(F.lit("Yes")), *v.coerce_direct(F.lit("indirect"))) == (None, "negative: -1", True, None, "I", None)
    assert one(spark, v.closeness(F.lit(1), 2), v.closeness(F.lit(9), 3)) == (0.5, 0.0)
    day = v.local_day(F.lit("2026-08-14 22:32:00").cast("timestamp"), "Asia/Beirut")
    assert one(spark, day, v.coerce_date(F.lit("14/08/2026")), v.parse_iso(F.lit("2026-08-14T01:00:00Z"))) == (datetime.date(2026, 8, 15), datetime.date(2026, 8, 14), datetime.datetime(2026, 8, 14, 1))


def test_greedy_windows():
    rows = [(1, 0, "a", True), (2, 50, "b", True), (3, 60, "a", True), (4, 70, "b", False), (5, 151, "b", True)]
    assert folds.greedy_window(rows, 100) == [(1, None), (2, 1), (3, None), (4, None), (5, 3)]


def test_sequential_copies_look_at_the_best_hit_only():
    rows = [(1, "strike near town hall", 0), (2, "strike near town hall", 1), (3, "strike near town hall today", 2)]
    assert folds.sequential_near_copies(rows, 0.9, 100) == {2: 1, 3: 1}


def test_relevance(spark):
    n = F.lit(None).cast("string")
    t, f = F.lit(True), F.lit(False)
    none = F.lit(None).cast("boolean")
    assert one(spark, relevance.upstream(t, n, n), relevance.upstream(f, F.lit("a"), F.lit("b")), relevance.upstream(none, F.lit("a"), F.lit("b")), relevance.upstream(none, F.lit("a"), F.lit(" "))) == ("relevant", "not_relevant", "relevant", None)


def test_alerts_and_thresholds(spark):
    assert one(spark, resolution.alert_kind(F.lit("تحليق طيران حربي")), resolution.alert_kind(F.lit("عبر البوت الجديد مسيره")), resolution.alert_kind(F.lit("AH-64"))) == (35, None, 38)
    names = spark.createDataFrame([(1, "air strike"), (2, "drone raid"), (39, "drone raid night")], "id int, name string")
    said = spark.createDataFrame([(1, "air strike"), (2, "drone raid night"), (3, "zzz")], "m int, said string")
    got = {r["m"]: (r["matched_id"], r["status"]) for r in resolution.resolve(said, "m", F.col("said"), names, "id", F.col("name"), required={39: ("heavy", "night fall")}).collect()}
    assert got == {1: (1, "matched"), 2: (2, "matched"), 3: (None, "unmatched")}


def test_records_keep_null_keys(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, None, 3), (1, None, 4)], "s int, k string, n int")
    assert sorted(r["n"] for r in records.unique(df, ["s", "k"], [F.col("n")]).collect()) == [1, 3, 4]
    assert sorted(r["n"] for r in records.unique(df, ["s", "k"], [F.col("n")], df.where("n = 1")).collect()) == [3, 4]


def test_category_rows(spark):
    cats = {"vehicles": {"did": "D", "name": None, "casualties": {"male_deaths": 1, "children_deaths": 5}, "vehicles": {"car": True, "excavator": True, "camion": True}}, "school_university": {"did": "I", "name": "x"}, "hospital": {"did": None, "name": "H", "casualties": {"male_deaths": 2}}}
    df = spark.createDataFrame([(1, cats, {"deaths": 3})], f"k int, c {details.CATEGORIES}, root struct<deaths: int, injuries: int>")
    r = details.widen(df, "k", "c", "root").first()
    assert (r["car"], r["card"], r["con_veh"], r["total_con"], r["other"], r["other_type"], r["hosd"], r["hos_n"], r["total_deaths"], r["total_injuries"]) == (True, 1, True, 2, True, "school_university_unclassified", 2, "H", 6, None)


def test_sources(spark, tmp_path):
    html = '<div class="tgme_widget_message" data-post="c/7"><time datetime="2024-01-01T02:00:00+02:00"></time><div class="tgme_widget_message_text">A<br>b</div><a class="tgme_widget_message_photo_wrap" style="background:url(\'u.png\')"></a></div><div class="tgme_widget_message" data-post="c/x"><time datetime="2024"></time></div>'
    assert html_cards.parse(html) == [{"message_id": 7, "message_datetime": datetime.datetime(2024, 1, 1), "text": "A\nb", "link": None, "image_urls": ["u.png"]}]
    (tmp_path / "s.csv").write_text("a,a,\n1,2,\n,,\n3,,4\n")
    rows = tables.sheet(spark, str(tmp_path / "s.csv")).orderBy("row_number").collect()
    assert [(r["row_number"], r["a"], r["a__2"], r["Column_3"]) for r in rows] == [(2, "1", "2", None), (4, "3", None, "4")]
    (tmp_path / "r.json").write_text('[{"k": 1, "n": "x"}, {"k": 1, "n": "y"}, {"k": 2, "n": "z"}]')
    got = tables.reference(spark, str(tmp_path / "r.json"), "k", "k int, n string", spark.createDataFrame([(2,)], "k int")).collect()
    assert [(r["k"], r["n"]) for r in got] == [(1, "x")]
    with pytest.raises(ValueError, match="missing columns: a, b"):
        tables.require(spark.range(1), ["b", "a"])


def test_cursor_feed_streams_once(spark, tmp_path):
    def fetch(after, limit):
        items = [{"id": i, "external_id": "x", "post_text": f"t{i}", "source_platform": "p", "include": None, "confidence": 0.5, "category": "c"} for i in range(after + 1, min(after + 3, 6))]
        return items, max([after, *(x["id"] for x in items)])

    spark.dataSource.register(cursor.feed("tidings_feed", fetch))
    q = spark.readStream.format("tidings_feed").load().writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    for _ in range(3):
        q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "o")).collect()
    assert sorted(r["external_message_id"] for r in got) == ["1", "2", "3", "4", "5"] and all(r["classification"] == {"include": None, "confidence": "0.5"} for r in got)
    assert {(r["raw_text"], r["source_platform"], r["origin_platform"], r["origin_account"]) for r in got} == {(f"t{i}", "p", "p", None) for i in range(1, 6)}
    assert cursor.normalize({"id": 4, "post_text": "x", "post_date": None})[5] is None


def test_latin_letters_of_a_batch_take_the_memory_of_a_few_texts():
    import tracemalloc

    import pyarrow as pa

    batch = pa.array([None, "", *("é" * 20_000 for _ in range(2000))])
    tracemalloc.start()
    got = x._ascii.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.slice(0, 3).to_pylist() == [None, "", "e" * 20_000] and len(got) == 2002 and peak < 10_000_000
