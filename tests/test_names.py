"""Names in texts by automaton, message cards by tree: against plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidings.functions import text as x
from tidings.operators import joins, names
from tidings.sources import html_cards

WORDS = ["ain", "el", "tyre", "st.", "al-qaa", "ras_beirut", "x", "بيروت", "صور", "Ém", "n1", "(old)", "e"]


@pytest.mark.parametrize("most", [1 << 20, 200])
def test_named_in(spark, most):
    """Every name on word boundaries, in one pass and in several; longest ones only on demand."""
    rng = random.Random(4)
    listed = sorted({" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(40)} | {"..", ""})
    texts = [None, "", "..", *(rng.choice(["", "#", "("]) + rng.choice([" ", "-", "_", ""]).join(rng.choice(WORDS) for _ in range(rng.randint(1, 9))) for _ in range(150))]
    want = {(k, n) for k, s in enumerate(texts) if s for n in listed if re.search(r"\w", n) and re.search(rf"(?<!\w){re.escape(n)}(?!\w)", s)}
    df, table = spark.createDataFrame(list(enumerate(texts)), "id int, said string"), spark.createDataFrame([(n, k) for k, n in enumerate(listed)], "name string, at int")
    got = joins.named_in(df, "id", F.col("said"), table, "name", most=most).select("id", "name").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100
    top = {k: max(len(n) for j, n in want if j == k) for k, _ in want}
    got = joins.named_in(df, "id", F.col("said"), table, "name", longest=True, most=most).select("id", "name").collect()
    assert sorted(map(tuple, got)) == sorted((k, n) for k, n in want if len(n) == top[k])
    assert joins.named_in(df, "id", F.col("said"), table.limit(0), "name").count() == 0


def test_a_text_is_read_once_and_not_exploded(spark):
    df, table = spark.createDataFrame([(1, "a b")], "id int, said string"), spark.createDataFrame([("a b c d e f g h",)], "name string")
    plan = joins.named_in(df, "id", F.col("said"), table, "name")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1


PLACES = [  # id, code, local name, English name, two more names
    (1, 62243, "عين بعال", "Ain Baal", None, "Aain Baal"), (2, 62218, "وادي جيلو", "Wadi Jilou", None, None), (3, 10, "الناقورة", "Naqoura", "Naqura", None), (4, 11, "المنصوري", "Mansouri", "Ras Naqura", None),
    (5, 12, "صور", "Sour", "صور", "Tyre"), (6, 13, "برج الشمالي", None, "Borj Ech-Chemali", None), (7, 14, "جرجوع", "Jarjouaa", "x", ""), (8, 15, None, None, "Naqura", "Tyre"), (9, None, "عين", "Ain", None, None), (10, 62246, "البازورية", "Bazouriye", None, None),
]
SAID = [
    None, "", "nothing here", "#طيران_حربي فوق #الناقورة", "غارات على بلدة المنصوري جنوب صور", "مسيّرة Nabatieh", "Al Shamali Hosh مسيرة", "Drone over Jarjouaa", "الناقورة قرب وادي حيلو", "near SHAHIM and #صور", "near AL_Bazuriya!",
    "#صور #الناقورة", "#لبنان #Naqura", "xNaqurax", "rasnaqura", "عين", "في عين بعال", "صورة", "Tyre", "#تحليق", "المنصوري [zone] صور", "[zone] nothing المنصوري", "zone", "Château Borj Ech Chemali", "الناقورة المنصوري", "#nowhere ras naqura", "aïn bâal",
]


def fold(s):
    s = re.sub("[\u064b-\u065f\u0670\u0640]", "", (s or "").replace("_", " ").strip().lower())
    s = s.translate(str.maketrans("أإآٱىةؤئ", "اااايهوي"))
    return " ".join(re.sub(r"[^\w\s\-]", " ", s).split())


def letters(s):
    s = unicodedata.normalize("NFKD", s or "").encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z]", "", s).replace("ch", "sh")


def plain(said, after):
    """The place of a message by looking for every name in turn."""
    said = (said or "").rsplit(after, 1)[-1]
    text, low = fold(said), letters(said)
    for alias, code in names.ALIASES:
        hit = fold(alias) in text if re.search("[\u0600-\u06ff]", alias) else letters(alias) in low
        owner = next((p[0] for p in PLACES if p[1] == code), None)
        if hit and owner:
            return owner, alias, "alias"
    known = [(fold(n), p[0]) for p in PLACES for n in (p[2], p[4], p[5]) if fold(n)]
    barred = {fold(v) for v in names.NOT_PLACES}
    for tag in (fold(v) for v in re.findall(r"#([^\s#]+)", said)):
        for n, place in known:
            if tag and tag not in barred and tag == n:
                return place, tag, "hashtag"
    hits = [(len(n), n, place) for n, place in known if len(n) >= 3 and re.search(rf"(?<!\w){re.escape(n)}(?!\w)", text)]
    if hits:
        _, n, place = max(hits, key=lambda h: h[0])
        return place, n, "name"
    hits = [(len(letters(n)), n, p[0]) for p in PLACES for n in (p[3], p[4], p[5]) if len(letters(n)) >= 4 and letters(n) in low]
    return (max(hits, key=lambda h: h[0])[2], max(hits, key=lambda h: h[0])[1], "latin") if hits else None


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_places_of_messages(spark, most):
    df = spark.createDataFrame(list(enumerate(SAID)), "id long, said string")
    places = spark.createDataFrame([(k, *p) for k, p in enumerate(PLACES)], "at int, id int, code int, ar string, en string, acs string, cad string")
    got = names.match_places(df, "id", F.col("said"), places, "id", "at", ["ar", "acs", "cad"], ["en", "acs", "cad"], "code", after="[zone]", most=most).collect()
    want = {k: plain(s, "[zone]") for k, s in enumerate(SAID)}
    assert {r["id"]: (r["place_id"], r["matched"], r["how"]) for r in got} == {k: v for k, v in want.items() if v} and len(got) == len({r["id"] for r in got})
    assert {v[2] for v in want.values() if v} == set(names.HOW)
    assert names.match_places(df, "id", F.col("said"), places.limit(0), "id", "at", ["ar"], ["en"], "code").count() == 0


def test_latin_letters_as_the_column_has_them(spark):
    said = ["Château-Chîh 3", "ﬁne ＡＢ", "İstanbul", "ß", "", "cch ch"]
    got = spark.createDataFrame(list(enumerate(said)), "k int, s string").select("k", x.latin_token(F.col("s"))).collect()
    assert [v for _, v in sorted(got)] == [names.latin_of(s) for s in said]


def test_hashtags(spark):
    said = ["a #b_c d#e##f # g #", "#x\u00a0y #z\ny", "", None, "no"]
    got = dict(spark.createDataFrame(list(enumerate(said)), "k int, s string").select("k", x.hashtags(F.col("s"))).collect())
    assert got == {0: ["b_c", "e", "f"], 1: ["x", "z"], 2: [], 3: None, 4: []}


def card(inside, number="c/7", time='<time datetime="2024-01-01T00:00:00Z"></time>'):
    return f'<div class="a tgme_widget_message b" data-post="{number}">{time}{inside}</div>'


def test_cards_by_tree():
    text = lambda s: f'<div class="tgme_widget_message_text">{s}</div>'
    of = lambda html: [(c["message_id"], c["text"]) for c in html_cards.parse(html)]
    assert of(card(text("quoted") + text("own"))) == [(7, "quoted")]
    assert of(card(text("one</span> two<br/>three <b> four </b>"))) == [(7, "one\ntwo\nthree\nfour")]
    assert of(card(text("a<p>b</div>c"))) == [(7, "a\nb")]
    assert of(card("<p><i>x</p>" + text("&lt;b&gt; &amp; é<script>no</script><!-- no -->"))) == [(7, "<b> & é")]
    assert of(card("", "c/9") + card(text("x"), "12") + card("", "c/x") + card("", time="<time></time>") + card("", time="")) == [(12, "x"), (9, "")]
    assert of(None) == [] and of("</div></p>") == [] and of('<div class="tgme_widget_message_text">x</div>') == []
    assert of("<div>" * 5000 + card(text("deep")) + "</div>" * 5000) == [(7, "deep")]
    photo = lambda style: f'<a class="tgme_widget_message_photo_wrap" style="{style}"></a>'
    got = html_cards.parse(card(photo("background-image:url('u.png')") + photo("color:red") + photo("background:url( v.png );w:1") + photo("a:url();b:url('w')")), "https://x/c")[0]
    assert got["image_urls"] == ["u.png", "v.png", "w"] and got["link"] == "https://x/c/7"
    assert html_cards.parse(card("", time='<time datetime="2024-01-01T02:00:00+02:00">'))[0]["message_datetime"].isoformat() == "2024-01-01T00:00:00"


def test_alerts_are_folded_once(spark, sf):
    """What routing reads of its messages is the written, folded text: no step makes or folds them again."""
    from tidings.plans import QUERIES

    plan = QUERIES["alert_routing"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_custkey" not in plan and "_folded" in plan
