"""Nested extraction results as one wide row: category fields, roll-ups, merging, edit checks, section output.

What goes where is data: CASUALTIES, PLACES and the keyword tables below; the functions build one select from them.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.values import map_diff, null_sum, true_count

COUNTS = ("deaths", "injuries", "male_deaths", "male_injuries", "female_deaths", "female_injuries", "children_deaths", "children_injuries", "elderly_deaths", "elderly_injuries")
VEHICLE_FLAGS = ("car", "moto", "con_veh", "excavator", "bulldozer", "camion", "bobcat", "tracteur")
BUILDERS = ("excavator", "bulldozer", "camion", "bobcat", "tracteur")
VEHICLE_COUNTS = ("moto_d", "moto_i", "con_d", "con_i")
CATEGORY = "struct<did: string, name: string, casualties: struct<" + ", ".join(f"{c}: int" for c in COUNTS) + ">, vehicles: struct<" + ", ".join([*(f"{f}: boolean" for f in VEHICLE_FLAGS), *(f"{c}: int" for c in VEHICLE_COUNTS)]) + ">>"
CATEGORIES = f"map<string, {CATEGORY}>"

# By category key its flag, D/ID column, name column, prefix of male/female columns and total columns.
CASUALTIES = {
    "lebanese_army": ("la", "la_did", None, "la", "la_td", "la_ti"),
    "unifil": ("unifil", "un_did", None, "un", "un_td", "un_ti"),
    "municipality": ("muni", "muni_did", None, "muni", "muni_td", "muni_ti"),
    "hospital": ("hosp", "hos_did", "hos_n", "hos", "hosd", "hosi"),
    "health_center": ("hc", "hc_did", None, "hc", "hcd", "hci"),
    "press": ("press", "press_did", "channel", "press", "pressd", "pressi"),
    "government_building": ("gov", "gb_did", "gov_n", "gb", "gbd", "gbi"),
}
# By category key the kinds of place in order of test: keywords, flag, D/ID column, name column.
PLACES = {
    "school_university": (
        (("مدرسة", "school", "ثانوية", "ابتدائية", "رياض"), "school", "sch_did", "school_name"),
        (("جامعة", "university", "معهد", "كلية", "college"), "uni", "uni_did", "uni_name"),
    ),
    "religious_cultural": (
        (("كنيسة", "church", "chapel", "كاتدرائية"), "church", "chu_did", "chu_n"),
        (("مسجد", "mosque", "جامع"), "mosque", "mos_did", "mosque_n"),
        (("مقبرة", "cemetery", "مدفن"), "ceme", "ceme_did", "ceme_n"),
        (("أثري", "archeolog", "تراث", "heritage"), "archeo", "arch_did", "arch_n"),
        (("ديني", "religious", "مزار", "shrine"), "releg", "releg_did", "releg_n"),
    ),
}
# Kinds of crossing in order of test.
LITANI = ("litani", "ليتاني", "الليتاني")
ZAHRANI = ("zahrani", "زرقاني", "الزرقاني")
DRONE = ("drone", "محلقة", "مسيرة", "طائرة مسيرة")
WATER = ("water", "مياه", "آبار", "بئر", "سقاية")
ELECTRIC = ("electric", "كهرب", "محطة كهرب")
MJNOUB = ("mjnoub", "مجنوب")
OLIVE = ("olive", "زيتون", "أشجار")
BRIDGE = ("جسر", "bridge")
ROAD = ("طريق", "road", "أوتوستراد", "autostrada")
BLOCKED = ("قطع", "blocked", "تعذر", "مسدود", "blockage")
# Marks in a warning's name.
WARNINGS = {"genocide": ("genocide", "إبادة"), "building": ("building", "مبن", "مبان"), "apart": ("apart", "شقة", "شقق")}


def has(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))


def category_columns(categories: Column) -> dict[str, Column]:
    """The wide row's columns, in the order that later ones may override earlier: null where nothing was said."""
    out: dict[str, Column] = {}
    yes = F.lit(True)

    def said(key: str) -> tuple[Column, Column]:
        cat = F.element_at(categories, F.lit(key))
        return cat, cat.isNotNull()

    def put(name: str, when: Column, value: Column) -> None:
        out[name] = F.when(when, value) if name not in out else F.coalesce(F.when(when, value), out[name])

    for key, (flag, did, name, prefix, deaths, injuries) in CASUALTIES.items():
        cat, on = said(key)
        c = cat["casualties"]
        put(flag, on, yes)
        put(did, on, cat["did"])
        if name:
            put(name, on, cat["name"])
        for letter, sex in (("m", "male"), ("f", "female")):
            put(f"{prefix}{letter}_d", on, c[f"{sex}_deaths"])
            put(f"{prefix}{letter}_i", on, c[f"{sex}_injuries"])
        put(deaths, on, null_sum(c["male_deaths"], c["female_deaths"]))
        put(injuries, on, null_sum(c["male_injuries"], c["female_injuries"]))

    cat, on = said("vehicles")
    v, c = cat["vehicles"], cat["casualties"]
    car = on & (v.isNull() | F.coalesce(v["car"], F.lit(False)))
    put("car", car, yes)
    for letter, who in (("m", "male"), ("f", "female"), ("c", "children")):
        put(f"car{letter}_d", car, c[f"{who}_deaths"])
        put(f"car{letter}_i", car, c[f"{who}_injuries"])
    put("card", car, null_sum(c["male_deaths"], c["female_deaths"]))
    put("cari", car, null_sum(c["male_injuries"], c["female_injuries"]))
    moto = F.coalesce(v["moto"], F.lit(False))
    put("moto", moto, yes)
    put("moto_did", moto, cat["did"])
    put("moto_d", moto, v["moto_d"])
    put("moto_i", moto, v["moto_i"])
    kinds = true_count(*(v[b] for b in BUILDERS))
    build = F.coalesce(v["con_veh"], F.lit(False)) | kinds.isNotNull()
    put("con_veh", build, yes)
    for b in BUILDERS:
        put(b, F.coalesce(v[b], F.lit(False)), yes)
    put("con_d", build, v["con_d"])
    put("con_i", build, v["con_i"])
    put("total_con", build, kinds)

    cat, on = said("emergency_civil_defense")
    put("emer", on, yes)
    put("emer_d", on, cat["casualties"]["deaths"])
    put("emer_i", on, cat["casualties"]["injuries"])

    cat, on = said("crossings_other")
    name, c, did = cat["name"], cat["casualties"], cat["did"]
    named = F.nullif(F.trim(name), F.lit("")).isNotNull()
    left = on
    for words, kind in ((LITANI, "litani"), (ZAHRANI, "zahrani"), (DRONE, "drone_f"), (WATER, "water"), (ELECTRIC, "electric"), (MJNOUB, "mjnoub")):
        hit = left & has(name, words)
        put(kind, hit, yes)
        if kind in ("water", "electric"):
            put(f"{kind}_did", hit, did)
            put(f"{kind}_type", hit & named, name)
        if kind == "mjnoub":
            put("mj_did", hit, did)
        left = left & ~has(name, words)
    olives = left & has(name, OLIVE)
    trees = olives & c["deaths"].isNotNull()
    put("olives_trees_d", trees, c["deaths"])
    other = (left & ~has(name, OLIVE)) | (olives & ~trees)
    put("crossing", left & ~has(name, OLIVE), yes)
    put("other", other, yes)
    put("other_did", other, did)
    put("other_type", other & named, name)
    put("other_d", on & ~trees, c["deaths"])
    put("other_i", on, c["injuries"])

    cat, on = said("warning_classification")
    name = F.lower(F.coalesce(cat["name"], F.lit("")))
    none = F.contains(name, F.lit("no_warning")) | F.contains(name, F.lit("لا تحذير"))
    put("no_warning", on & none, yes)
    put("warning", on & ~none & has(name, ("warning", "تحذير")), yes)
    for flag, words in WARNINGS.items():
        put(flag, on & has(name, words), yes)

    for key, kinds_ in PLACES.items():
        cat, left = said(key)
        for words, flag, did, name in kinds_:
            hit = left & has(cat["name"], words)
            put(flag, hit, yes)
            put(did, hit, cat["did"])
            put(name, hit, cat["name"])
            left = left & ~has(cat["name"], words)
        put("other", left, yes)
        put("other_did", left, cat["did"])
        put("other_type", left, F.lit(f"{key}_unclassified"))

    cat, on = said("road_bridge")
    name = cat["name"]
    named = F.nullif(F.trim(name), F.lit("")).isNotNull()
    bridge, blocked = on & has(name, BRIDGE), has(name, BLOCKED)
    road = on & (has(name, ROAD) | ~has(name, BRIDGE))
    put("bridge", bridge, yes)
    put("bridge_name", bridge & named, name)
    put("bridge_blocked", bridge & blocked, yes)
    put("road", road, yes)
    put("road_d_id", road, cat["did"])
    put("road_name", road & named, name)
    put("road_blocked", road & blocked, yes)
    return out


# The category totals that add up to an event's deaths and injuries.
TOTAL_DEATHS = ("la_td", "un_td", "muni_td", "hosd", "hcd", "pressd", "gbd", "card", "emer_d")
TOTAL_INJURIES = ("la_ti", "un_ti", "muni_ti", "hosi", "hci", "pressi", "gbi", "cari", "emer_i")


def widen(df: DataFrame, key: str, categories: str, root: str | None = None, keep: list[str] = ()) -> DataFrame:
    """(key, keep, wide columns, total_deaths, total_injuries) of each row; root is a struct with the counts that no category owns."""
    flat = df.select(key, *keep, *([root] if root else []), *(v.alias(k) for k, v in category_columns(F.col(categories)).items()))
    mine = lambda f: [F.col(f"{root}.{f}")] if root else []
    return flat.withColumns({"total_deaths": null_sum(*mine("deaths"), *map(F.col, TOTAL_DEATHS)), "total_injuries": null_sum(*mine("injuries"), *map(F.col, TOTAL_INJURIES))}).drop(*([root] if root else []))


def pair_totals(prefix: str, children: bool = False) -> tuple[Column, Column]:
    """Deaths and injuries from the columns by sex, for cars with children: the form that edits use."""
    letters = "mfc" if children else "mf"
    return tuple(null_sum(*(F.col(f"{prefix}{x}_{k}") for x in letters)) for k in "di")


def merge(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the largest number, true before false before null, else the first value that is not null in order."""
    aggs = []
    for c, t in rows.dtypes:
        if c in keys:
            continue
        if t in ("int", "bigint", "double", "float", "smallint"):
            aggs.append(F.max(c).alias(c))
        elif t == "boolean":
            aggs.append(F.bool_or(c).alias(c))
        else:
            aggs.append(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c))
    return rows.groupBy(*keys).agg(*aggs)


def edit_errors(old: Column, edit: Column, known: list[str], automated: list[str], gates: dict[str, str]) -> Column:
    """Errors of an edit (map of field to text) against the stored row (a map): unknown or automated fields, a D/ID value without its flag, and a flag that is set without its D/ID value or cleared while that stays."""
    new = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(edit), k)), edit)
    bad = F.transform(F.filter(F.map_keys(edit), lambda k: ~k.isin(*known)), lambda k: F.concat(F.lit("unknown field: "), k))
    auto = F.transform(F.filter(F.map_keys(edit), lambda k: k.isin(*automated)), lambda k: F.concat(F.lit("computed field: "), k)) if automated else F.array().cast("array<string>")
    checks = []
    for field, flag in gates.items():
        on = F.coalesce(F.element_at(new, flag) == "1", F.lit(False))
        filled = F.coalesce(F.trim(F.element_at(new, field)) != "", F.lit(False))
        checks.append(F.when(filled & ~on, F.lit(f"{field} needs {flag}")).when(on & ~filled, F.lit(f"{flag} needs {field}")))
    return F.sort_array(F.concat(bad, auto, F.filter(F.array(*checks), lambda x: x.isNotNull())))


def edit_diff(old: Column, edit: Column) -> Column:
    return map_diff(old, edit)


def sections(row_fields: dict[str, list[str]], gates: dict[str, str]) -> Column:
    """A map of the fields that are not null in sections whose flag is on, booleans as 0/1."""
    entries = [F.when(F.col(gates[s]), F.struct(F.lit(f).alias("k"), F.col(f).cast("string").alias("v"))) for s, fields in row_fields.items() for f in fields]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull() & e["v"].isNotNull()))


def empty_detail(category: Column) -> Column:
    """Whether a category tells nothing: no direct mark, no name, no vehicle that is there, no count."""
    vehicles = reduce(lambda a, b: a | b, (F.coalesce(category["vehicles"][f], F.lit(False)) for f in VEHICLE_FLAGS)) | F.coalesce(*(category["vehicles"][c] for c in VEHICLE_COUNTS)).isNotNull()
    return category["did"].isNull() & category["name"].isNull() & ~vehicles & F.coalesce(*(category["casualties"][c] for c in COUNTS)).isNull()


DEMOGRAPHICS = "casualty_demographics"


def assemble(messages: DataFrame, id_: str, categories: str, root: str, answers: DataFrame, key: str, detail: str, error: str) -> DataFrame:
    """(id, categories, failed, empty, root): each message's categories of the first tier with those that the second tier answered, which win. answers: one row a message and category, with its detail or an error; a failed or empty one leaves the others as they are and is named. Root counts, if there are any, become the demographics category where that is absent. Ids are unique; answers to unknown ids are left out."""
    told = F.col(error).isNull() & F.col(detail).isNotNull()
    blank = F.col(error).isNull() & F.coalesce(empty_detail(F.col(detail)), F.lit(True))
    entry = F.struct(F.col(key).alias("key"), F.col(detail).alias("value"))
    got = answers.groupBy(id_).agg(
        F.map_from_entries(F.collect_list(F.when(told & ~blank, entry))).cast(CATEGORIES).alias("_second"),
        F.sort_array(F.collect_set(F.when(F.col(error).isNotNull(), F.col(key)))).alias("failed"),
        F.sort_array(F.collect_set(F.when(blank, F.col(key)))).alias("empty"),
    )
    none, names = F.create_map().cast(CATEGORIES), F.array().cast("array<string>")
    x = messages.select(id_, F.coalesce(categories, none).alias("_first"), F.col(root).alias("_root")).join(got, id_, "left")
    x = x.withColumn("_second", F.coalesce("_second", none))
    both = F.map_concat(F.map_filter("_first", lambda k, _: ~F.map_contains_key(F.col("_second"), k)), "_second")
    counted = F.coalesce(*(F.col("_root")[c] for c in COUNTS)).isNotNull()
    own = F.struct(F.lit(None).cast("string").alias("did"), F.lit(None).cast("string").alias("name"), F.struct(*(F.col("_root")[c].alias(c) for c in COUNTS)).alias("casualties"), F.lit(None).alias("vehicles"))
    more = F.create_map(F.lit(DEMOGRAPHICS), own).cast(CATEGORIES)
    out = F.when(counted & ~F.map_contains_key(F.col("_both"), F.lit(DEMOGRAPHICS)), F.map_concat("_both", more)).otherwise(F.col("_both"))
    return x.withColumn("_both", both).select(id_, out.alias("categories"), F.coalesce("failed", names).alias("failed"), F.coalesce("empty", names).alias("empty"), F.col("_root").alias("root"))


def fill(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the fields of incoming filled in: the larger number, true before false before null, else what is stored and only then what comes. Rows that incoming lacks stay; fields that stored lacks are left out; one row a key on both sides."""
    kinds, have = dict(stored.dtypes), set(incoming.columns)
    x = stored.alias("s").join(incoming.alias("i"), keys, "left")

    def field(c: str) -> Column:
        old, new = F.col(f"s.{c}"), F.col(f"i.{c}")
        if kinds[c] in ("int", "bigint", "double", "float", "smallint"):
            return F.greatest(old, new)
        if kinds[c] == "boolean":
            return F.when(old | new, True).otherwise(F.coalesce(old, new))
        return F.coalesce(old, new)

    return x.select(*keys, *((field(c) if c in have else F.col(f"s.{c}")).alias(c) for c in stored.columns if c not in keys))
