"""Queries over small tables of their own, against plain Python over all rows and whole texts."""

import datetime
import random
import re
import unicodedata

from tidings import plans
from tidings.functions.similarity import word_similarity_of


def write(spark, sf, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/{name}.parquet")


def near_copies(rows, threshold, days):
    """Of one supplier's rows (id, text, day), in id order: the best unmarked row within the window, if it is an earlier one."""
    marked = {}
    for id_, text, day in sorted(rows):
        best = None
        for k, t, d in rows:
            if k != id_ and k not in marked and abs((d - day).days) <= days:
                hit = (-word_similarity_of(t, text), k)
                best = hit if best is None or hit < best else best
        if best and -best[0] >= threshold and best[1] < id_:
            marked[id_] = best[1]
    return marked


def test_near_dup_sequential(spark, tmp_path):
    """Late orders, time gaps and orders that repeat on both sides of a gap."""
    rnd = random.Random(7)
    names = ["small ring", "small rings", "red widget", "red widgets", "blue bolt"]
    write(spark, tmp_path, "part", list(enumerate(names)), "p_partkey long, p_name string")
    first = datetime.datetime(1995, 1, 1)
    lines = []
    for supplier in range(3):
        for stretch in range(3):
            for _ in range(12):
                lines.append((rnd.randrange(1500, 9000), 1, rnd.randrange(5), supplier, first + datetime.timedelta(stretch * 1400 + rnd.randrange(600))))
        lines.append((lines[-1][0], 1, 0, supplier, first))
        lines.append((8000, 2, 0, supplier, first))
    write(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp")
    found = sorted(map(tuple, plans.QUERIES["near_dup_sequential"](spark, str(tmp_path)).collect()))
    want = []
    for supplier in range(3):
        want += near_copies([(k, names[p], d) for k, n, p, s, d in lines if s == supplier and n == 1], 0.6, 400).items()
    assert found == sorted(want) and max(found)[0] >= 2000


TEXTS = [
    "One, two. THREE",
    " (first) line, \n  Second   line: 'more'! ",
    "أحمد  إلى آخر،\nمَدْرَسـة، \nثالث أ!",
    "plain 🚨 first\nlater ☀️ and 🚨 again",
    "..., only, ends ...",
    "\n\nafter blank lines\n",
    "",
    None,
]


def documents(spark, sf, texts=TEXTS):
    write(spark, sf, "documents", list(enumerate(texts)), "doc_id long, text string")


def got(spark, sf, name):
    return {r["doc_id"]: r[1] for r in plans.QUERIES[name](spark, str(sf)).collect()}


def squeeze(s):
    return re.sub(r"\s+", " ", s).strip()


def test_text_normalize_en(spark, tmp_path):
    documents(spark, tmp_path)
    edge = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~،؛؟"
    want = {k: None if s is None else squeeze(s.lower().strip().strip(edge)) for k, s in enumerate(TEXTS)}
    assert got(spark, tmp_path, "text_normalize_en") == want and want[1] == "first) line, second line: 'more"


def test_text_normalize_ar(spark, tmp_path):
    documents(spark, tmp_path)
    fold = str.maketrans("أإآٱة", "ااااه")
    full = lambda s: re.sub("[ً-ْـ]", "", f"  {s}ًأهلآ ةـ  إلى").translate(fold)
    want = {k: None if s is None else squeeze(full(s).strip().strip("،.؛!؟\"'")) for k, s in enumerate(TEXTS)}
    assert got(spark, tmp_path, "text_normalize_ar") == want and "مدرسه، ثالث ا" in want[2]


def test_emoji_strip(spark, tmp_path):
    documents(spark, tmp_path)
    want = {k: None if s is None else "a" + re.sub("[🚨☀\ufe0f]", "", s) + "b" for k, s in enumerate(TEXTS)}
    assert got(spark, tmp_path, "emoji_strip") == want and want[3].endswith("later  and  againb")


def test_alert_kinds(spark, tmp_path):
    """Alert words and notices late in long texts."""
    from tidings.operators.resolution import ALERTS, NOTICES

    late = [w for _, words in ALERTS for w in words[:1]] + ["an Apache", "the AH-64!", NOTICES[0], "nothing"]
    texts = [f"{'filler words ' * 200}\n{w} end" for w in late for _ in range(5)] + [None] * 5
    documents(spark, tmp_path, texts)
    said = ("تحليق طيران حربي", "مُسيّرة في الأجواء", "AH-64 seen", "نرجو منكم ابلاغنا فورا طيران حربي", "no alert")

    def fold(s):
        s = re.sub("[ً-ٰٟـ]", "", s.replace("_", " ").strip().lower()).translate(str.maketrans("أإآٱىةؤئ", "اااايهوي"))
        return squeeze(re.sub(r"[^\w\s-]", " ", s))

    def kind(s):
        s = fold(s)
        if any(fold(w) in s for w in NOTICES):
            return None
        return next((c for c, words in ALERTS if any(fold(w) in s for w in words)), None)

    want = {k: kind(f"{said[k % 5]} {s or ''}") for k, s in enumerate(texts)}
    assert got(spark, tmp_path, "alert_kinds") == want
    assert [want[5 * i + 4] for i in range(len(late))] == [35, 36, 38, 38, 38, None, None]


def test_word_similarity_topk(spark, tmp_path):
    """Names that occur from the seventh word on, and more parts of one name than the five that are asked for."""
    names = ["small ring", "red widget", "blue bolt", "red ring", "tiny gear", "zq xv"]
    parts = [(k, names[k * 5 % 7 % 6]) for k in range(40)] + [(40, None)]
    words = "one two three four five six seven eight"
    items = [(1, f"{words} then a red widget at last"), (2, f"tiny gears and {words} small rings"), (3, f"{words} blue"), (4, None), (5, "...")]
    write(spark, tmp_path, "part", parts, "p_partkey long, p_name string")
    write(spark, tmp_path, "benchmark", items, "item_id long, text string")
    found = sorted(map(tuple, plans.QUERIES["word_similarity_topk"](spark, str(tmp_path)).select("item_id", "rank", "p_partkey", "ws", "coverage").collect()))

    def grams(s):
        return {f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", s.lower()) for i in range(len(w) + 1)}

    want = []
    for item, text in items:
        hits = [(k, word_similarity_of(n, text), word_similarity_of(text, n)) for k, n in parts if n and text and grams(n) & grams(text)]
        best = sorted((-ws * back, -ws, k) for k, ws, back in hits)[:5]
        want += [(item, r, k, -ws, -c) for r, (c, ws, k) in enumerate(best, 1)]
    assert found == want and dict(parts)[found[0][2]] == "red widget"


def test_latin_place_token(spark, tmp_path):
    texts = [*TEXTS, "strikes were reported near Château Chîh,\nand in Bint-Jbeil 3 later"]
    documents(spark, tmp_path, texts)
    fold = lambda s: re.sub("[^a-z]", "", unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()).replace("ch", "sh")
    want = {k: None if s is None else fold(s) for k, s in enumerate(texts)}
    found = got(spark, tmp_path, "latin_place_token")
    assert found == want and "shateaushih" in found[len(TEXTS)] and "bintjbeil" in found[len(TEXTS)]


def test_names_of_any_length_and_signs(spark):
    """As the reference: the escaped name on word boundaries."""
    from pyspark.sql import functions as F

    from tidings.operators import joins

    names = ["kafr", "kafr kila", "ain al hilweh old camp", "bint-jbeil", "st. mary", "o'hara", "saudi arabia", "(x)", ".net"]
    texts = ["at kafr kila, bint-jbeil", "bint jbeil and ain al hilweh old camp", "st. mary o'hara", "st mary ohara", "saudi-arabia", "y (x) z", "y(x) a.net", ".net", "", None]
    found = joins.named_in(spark.createDataFrame(list(enumerate(texts)), "id int, said string"), "id", F.col("said"), spark.createDataFrame([(n,) for n in names], "name string"), "name")
    want = {(k, n) for k, s in enumerate(texts) for n in names if s and re.search(rf"(?<!\w){re.escape(n)}(?!\w)", s)}
    assert sorted(map(tuple, found.collect())) == sorted(want) and (1, "ain al hilweh old camp") in want


def test_near_copies_of_a_block_compare_each_pair_of_texts_once(monkeypatch):
    """Rows of few texts, some of one id, against a plain loop; each two texts are compared once, over blocks too."""
    import random

    from tidings.functions.similarity import word_similarity_of
    from tidings.operators import folds

    def plain(rows, threshold, window):
        marked = {}
        for id_, text, at in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2])):
            near = [(-(word_similarity_of(t, text) or 0.0), k) for k, t, s in rows if k != id_ and k not in marked and abs(s - at) <= window]
            if near and -min(near)[0] >= threshold and min(near)[1] < id_:
                marked[id_] = min(near)[1]
        return marked

    r, calls, names = random.Random(7), [], ["red anvil", "red anvils", "big red anvil", "rod", "hot rod", "hot rods", None]
    blocks = [[(r.randrange(250), r.choice(names), r.choice([r.random() * 90, float("nan")]) if i % 9 == 0 else r.random() * 90) for i in range(200)] for _ in range(4)]
    want = [plain(rows, t, 7.0) for rows in blocks for t in (0.5, 0.9)]
    monkeypatch.setattr(folds, "word_similarity_of", lambda a, b: calls.append((a, b)) or word_similarity_of(a, b), raising=False)
    assert [folds.sequential_near_copies(rows, t, 7.0) for rows in blocks for t in (0.5, 0.9)] == want and any(want)
    assert len(calls) == len(set(calls)) == 36
