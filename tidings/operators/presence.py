"""The gate of present categories: a model's answer is held against the message's own terms.

Every text is read once into a positional index of terms (names.term_index); the rules are Columns over that index. A category
whose evidence only sets the scene goes; the rescue category comes in where a rescue organization is named.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.operators.names import term_index

# Category keys.
CATEGORIES = (
    "casualty_demographics", "lebanese_army", "unifil", "municipality", "school_university", "religious_cultural", "hospital", "health_center",
    "emergency_civil_defense", "press", "government_building", "road_bridge", "vehicles", "crossings_other", "warning_classification",
)
# Categories of buildings, whose evidence may be a landmark only.
BUILDINGS = ("hospital", "health_center", "religious_cultural", "school_university", "municipality", "government_building")
# Terms by what they tell.
TERMS = {
    "near": ("قرب", "بالقرب", "بجوار", "بجانب", "محيط", "أمام", "محاذاة"),
    "unharmed": ("لم تسجل أضرار", "لم تسجّل أضرار", "دون تسجيل إصابات", "من دون تسجيل إصابات", "لا أضرار"),
    "harm": ("استهدف", "استهدفت", "أصاب", "أصابت", "سقطت", "تضرر", "تضررت", "أضرار", "دمر", "دمرت", "قطع", "تعذر مرور", "أصيب", "أصيبت", "قتل", "قتلت", "استشهد", "جرح", "جرحت", "إخلاء"),
    "road": ("الطريق", "الجسر", "الأوتوستراد"),
    "road_harm": ("استهدف الطريق", "استهدفت الطريق", "قطع", "تعذر مرور"),
    "escort": ("مواكبة", "بمواكبة"),
    "army_harm": ("استهدف الجيش", "استهدفت الجيش", "أصيب عسكري", "قتل عسكري"),
    "ward": ("قسم الطوارئ",),
    "rescuer": ("الدفاع المدني", "الصليب الأحمر", "إسعاف", "مسعف"),
    "locality": ("بلدة", "مدينة", "قرية", "مزارع", "دوحة", "مشاع", "اطراف", "أطراف", "حرش", "وادي"),
    "attack": ("استهدف", "استهدفت", "قصف", "غارة", "أغار", "اعتد"),
    "town_hall": ("بلدية", "مبنى البلدية", "مباني البلدية", "مجلس بلدي", "مجلس البلدة", "موظف", "موظفين", "موظفي البلدية", "عامل", "عاملين", "موظف بلدي"),
    "vehicle": (
        "سيارة", "سيارات", "مركبة", "مركبات", "آلية", "آليات", "دراجة", "دراجات", "موتور", "موتورات", "شاحنة", "شاحنات",
        "جرافة", "جرافات", "حفارة", "حفارات", "دبابة", "دبابات", "كميون", "بلدوزر",
    ),
    "admission": ("إلى المستشفى", "الى المستشفى"),
    "organization": ("الدفاع المدني", "دفاع مدني", "الصليب الأحمر", "الهلال الأحمر", "الإسعاف", "إسعاف", "مسعف", "سيارة إسعاف", "سيارات إسعاف", "فرق الإنقاذ"),
}
RESCUE, BEFORE, AFTER = "emergency_civil_defense", 20, 40
_ANSWER = "struct<categories_present: array<string>, category_evidence: array<struct<category_key: string, evidence_span: string>>>"
_CASE = "struct<category_key: string, evidence_span: string>"
_BLANKS = " \t\n\x0b\x0c\r"


def told(hits: Column, group: str) -> Column:
    return F.exists(hits, lambda h: h["group"] == group)


def context_only(category: Column, span: Column, own: Column, post: Column) -> Column:
    """Whether evidence only sets the scene. own, post: indexes of the evidence and of the message; what either tells counts for rules on the whole."""
    whole = lambda g: told(own, g) | told(post, g)
    is_ = lambda c: category == c
    building = category.isin(*BUILDINGS)
    shown = F.when(span != "", own).otherwise(post)
    attacked_place = told(shown, "locality") & told(shown, "attack") & ~told(shown, "town_hall")
    return (
        F.when(building & whole("unharmed"), True)
        .when(building & told(own, "near"), ~told(own, "harm"))
        .when(is_("road_bridge"), told(own, "road") & ~told(own, "road_harm"))
        .when(is_("lebanese_army"), whole("escort") & ~whole("army_harm"))
        .when(is_(RESCUE), whole("ward") & ~whole("rescuer"))
        .when(is_("municipality"), attacked_place | ~whole("town_hall") & told(own, "locality"))
        .when(is_("vehicles"), ~whole("vehicle"))
        .when(is_("hospital"), whole("admission") & ~whole("harm"))
        .otherwise(False)
    )


def _cases(answer: Column) -> Column:
    """Known categories in order, each once, with its first evidence; empty without any."""
    known = F.array_distinct(F.filter(F.coalesce(answer["categories_present"], F.array().cast("array<string>")), lambda c: c.isin(*CATEGORIES)))
    evidence = F.coalesce(answer["category_evidence"], F.array().cast(f"array<{_CASE}>"))

    def case(c: Column) -> Column:
        first = F.get(F.filter(evidence, lambda e: e["category_key"] == c), 0)
        return F.struct(c.alias("category_key"), F.coalesce(F.btrim(first["evidence_span"], F.lit(_BLANKS)), F.lit("")).alias("evidence_span"))

    return F.transform(known, case)


def _malformed(raw: Column, answer: Column) -> Column:
    """An answer that is no object, or whose parts have another form than lists of strings and of evidence with a category."""
    part = lambda name: answer[name].isNull() & F.get_json_object(raw, f"$.{name}").isNotNull()
    unnamed = F.exists(answer["category_evidence"], lambda e: e["category_key"].isNull())
    return F.try_parse_json(raw).isNull() | ~F.coalesce(F.ltrim(raw).startswith("{"), F.lit(False)) | part("categories_present") | part("category_evidence") | F.coalesce(unnamed, F.lit(False))


def gate(messages: DataFrame, id_: str, post: str, raw: str) -> DataFrame:
    """(id, status, categories, evidence) of each message from the model's answer, JSON text in column raw. A malformed or missing answer has status `malformed` and no categories. Ids are unique; a null message is empty."""
    answer = F.from_json(raw, _ANSWER)
    x = messages.select(F.col(id_), F.coalesce(F.col(post), F.lit("")).alias("_post"), F.col(raw).alias("_raw"), answer.alias("_a"))
    x = x.select(id_, "_post", _malformed(F.col("_raw"), F.col("_a")).alias("_bad"), _cases(F.col("_a")).alias("_cases"))
    texts = F.concat(F.array("_post"), F.transform("_cases", lambda c: c["evidence_span"]))
    row = F.struct(id_, "_post", "_bad", "_cases")
    indexed = term_index(x.select(row.alias("_row"), texts.alias("_t")), "_row", F.col("_t"), TERMS).select("_row.*", "index")
    about = F.get("index", 0)
    pairs = F.arrays_zip(F.col("_cases").alias("c"), F.slice("index", F.lit(2), F.size("index")).alias("own"))
    kept = F.filter(pairs, lambda p: ~context_only(p["c"]["category_key"], p["c"]["evidence_span"], p["own"], F.get(F.col("index"), 0)))
    y = indexed.select(id_, "_post", "_bad", about.alias("_about"), F.transform(kept, lambda p: p["c"]).alias("_kept"))
    org = F.array_min(F.transform(F.filter("_about", lambda h: h["group"] == "organization"), lambda h: F.struct(h["rank"], h["at"], h["size"])))
    start = F.greatest(org["at"] - BEFORE, F.lit(1))
    around = F.btrim(F.substr("_post", start, org["at"] + org["size"] + AFTER - start), F.lit(_BLANKS))
    added = F.when(org.isNotNull() & ~F.exists("_kept", lambda k: k["category_key"] == RESCUE), F.array(F.struct(F.lit(RESCUE).alias("category_key"), around.alias("evidence_span"))))
    none = F.array().cast(f"array<{_CASE}>")
    out = F.when(F.col("_bad"), none).otherwise(F.concat(F.col("_kept"), F.coalesce(added, none)))
    z = y.select(id_, F.when(F.col("_bad"), "malformed").otherwise("ok").alias("status"), out.alias("evidence"))
    return z.select(id_, "status", F.transform("evidence", lambda e: e["category_key"]).alias("categories"), "evidence")
