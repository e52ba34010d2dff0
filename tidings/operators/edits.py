"""Edits of stored wide rows: coerced, checked, applied, with computed fields, totals and what changed."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.text import strip_emoji
from tidings.functions.values import null_sum, true_count
from tidings.operators.details import BUILDERS, CASUALTIES, PLACES, TOTAL_DEATHS, TOTAL_INJURIES, pair_totals

# The fields that an edit names as computed; D/ID columns beyond those of the category tables, by flag; flags with fields of their own.
COMPUTED = ("la_td", "la_ti", "un_td", "un_ti", "muni_td", "muni_ti", "car_d", "car_i", "total_con")
MORE_MARKS = {"road": "road_d_id", "moto": "moto_did", "water": "water_did", "electric": "electric_did", "mjnoub": "mj_did", "other": "other_did"}
MORE_FIELDS = {
    "car": ("carm_d", "carm_i", "carf_d", "carf_i", "carc_d", "carc_i"),
    "moto": ("moto_did", "moto_d", "moto_i"),
    "con_veh": (*BUILDERS, "con_d", "con_i"),
    "emer": ("emer_d", "emer_i"),
    "road": ("road_d_id", "road_name", "road_blocked"),
    "bridge": ("bridge_name", "bridge_blocked"),
    "water": ("water_did", "water_type"),
    "electric": ("electric_did", "electric_type"),
    "mjnoub": ("mj_did",),
    "other": ("other_did", "other_type", "other_d", "other_i"),
}
# By prefix of the columns by sex the computed deaths and injuries, and whether children count.
SUMS = {prefix: (deaths, injuries, False) for _, _, _, prefix, deaths, injuries in CASUALTIES.values()} | {"car": ("card", "cari", True)}
SPACED = ("hc", "press", "muni", "gb", "car", "hos")


def field_name(column: str) -> str:
    """The name by which edits know a column: `hosm_d` is `hos_m_d`, `card` is `car_d`, `children_d` is `child_d`."""
    for p in SPACED:
        if column[: len(p)] == p and column[len(p) : -2] in ("m", "f", "c") and column[-2:] in ("_d", "_i"):
            return f"{p}_{column[len(p) :]}"
    return {"card": "car_d", "cari": "car_i", "children_d": "child_d", "children_i": "child_i", "school_damage_level": "sch_damage_level"}.get(column, column)


@dataclass(frozen=True)
class Form:
    """Editable columns with their kinds (flag, count, mark, text), D/ID columns by flag, and the fields that go with a flag."""

    kinds: dict[str, str]
    marks: dict[str, str]
    fields: dict[str, tuple[str, ...]]


def form_of(rows: DataFrame, leave: list[str]) -> Form:
    """The form of a table's columns but those to leave and the computed ones."""
    marks = {flag: did for flag, did, *_ in CASUALTIES.values()} | {flag: did for kinds in PLACES.values() for _, flag, did, _ in kinds} | MORE_MARKS
    own = {flag: tuple(x for x in (did, name, *(f"{prefix}{s}_{k}" for s in "mf" for k in "di")) if x) for flag, did, name, prefix, *_ in CASUALTIES.values()}
    own |= {flag: (did, name) for kinds in PLACES.values() for _, flag, did, name in kinds} | MORE_FIELDS
    sums = {c for d, i, _ in SUMS.values() for c in (d, i)} | {"total_con", "total_deaths", "total_injuries"}
    kinds = {}
    for c, t in rows.dtypes:
        if c not in leave and c not in sums:
            kinds[c] = "mark" if c in marks.values() else {"boolean": "flag", "string": "text"}.get(t, "count")
    return Form(kinds, {f: d for f, d in marks.items() if f in kinds and d in kinds}, {f: tuple(c for c in cs if c in kinds) for f, cs in own.items() if f in kinds})


def coerce(raw: Column, kind: str) -> tuple[Column, Column]:
    """(value, whether it is none of this kind) of an edit's text. Flags: 1, true, yes, or 0, false, no and blank; counts: digits, blank is null; marks: D or direct, ID or indirect, empty is null; texts: without emoji and blanks around, empty is null."""
    low = F.lower(F.trim(raw))
    if kind == "flag":
        value = F.when(low.isin("1", "true", "yes"), True).when(low.isin("", "0", "false", "no"), False)
        return value, raw.isNotNull() & value.isNull()
    if kind == "count":
        value = F.when(low.rlike("^[0-9]+$"), low.try_cast("int"))
        return value, F.coalesce(low != "", F.lit(False)) & value.isNull()
    if kind == "mark":
        value = F.when(low.isin("d", "direct"), "D").when(low.isin("id", "indirect"), "ID")
        return value, F.coalesce(raw != "", F.lit(False)) & value.isNull()
    return F.nullif(F.trim(strip_emoji(raw)), F.lit("")), F.lit(False)


def _shown(x: Column, kind: str) -> Column:
    return (x.cast("int") if kind == "flag" else x).cast("string")


def apply_edits(stored: DataFrame, edits: DataFrame, key: str, edit: str, deaths: str = "deaths", injuries: str = "injuries") -> DataFrame:
    """The columns of stored after the edits, with `errors`, and `old_values` and `new_values` (maps of field to text, null for none) of what changed.

    stored: wide rows with total_deaths, total_injuries and the root counts `deaths` and `injuries`; edits: (key, map of field to text), one a row; rows without an edit stay, edits of unknown rows go. Rows with errors stay as they are. Checks go in steps, and a step that fails ends them: no field at all; computed fields; unknown fields; texts that are none of their kind; a D/ID value for a flag that is off, and values of a flag that the same edit clears; a flag that is on without its D/ID value. Computed fields and totals are then summed anew, null where nothing was said; they are among the changes, as are both totals if one changed. An edit that is null is no edit.
    """
    form = form_of(stored, [key, deaths, injuries])
    e = edits.select(key, F.col(edit).alias("_e")).where("_e is not null")
    x = stored.join(e, key, "left")
    given = F.col("_e")
    on = lambda c: F.coalesce(c, F.lit(False))
    names = {c: field_name(c) for c in form.kinds}
    raw = {c: F.element_at(given, F.lit(n)) for c, n in names.items()}
    pairs = {c: coerce(raw[c], k) for c, k in form.kinds.items()}
    # first projection: what is given, what it means and whether it is wrong; second: the row as it would be
    x = x.select("*", *(on(F.map_contains_key(given, F.lit(n))).alias(f"_in_{c}") for c, n in names.items()), *(pairs[c][0].alias(f"_v_{c}") for c in names), *(on(pairs[c][1]).alias(f"_bad_{c}") for c in names))
    x = x.select("*", *(F.when(F.col(f"_in_{c}"), F.col(f"_v_{c}")).otherwise(F.col(c)).alias(f"_n_{c}") for c in names))

    keys = F.sort_array(F.map_keys(given))
    listed = lambda entries: F.filter(F.array(*entries), lambda m: m.isNotNull()) if entries else F.array().cast("array<string>")
    told = lambda c: F.coalesce(F.col(f"_v_{c}") if form.kinds[c] == "flag" else F.col(f"_v_{c}") > 0 if form.kinds[c] == "count" else ~F.trim(f"_v_{c}").isin("", "0"), F.lit(False))
    gates = [F.when(F.col(f"_in_{d}") & ~on(F.col(f"_n_{f}")), F.lit(f"{names[d]} needs {names[f]}")) for f, d in form.marks.items()]
    gates += [F.when(F.col(f"_in_{f}") & ~on(F.col(f"_v_{f}")) & F.col(f"_in_{c}") & told(c), F.lit(f"{names[f]} is cleared, not {names[c]}")) for f, cs in form.fields.items() for c in cs]
    steps = [
        F.when(F.size(keys) == 0, F.array(F.lit("no field"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(keys, lambda k: k.isin(*COMPUTED)), lambda k: F.concat(F.lit("computed field: "), k)),
        F.transform(F.filter(keys, lambda k: ~k.isin(*names.values())), lambda k: F.concat(F.lit("unknown field: "), k)),
        listed([F.when(F.col(f"_bad_{c}"), F.lit(f"{names[c]} is no {form.kinds[c]}")) for c in names]),
        listed(gates),
        listed([F.when(on(F.col(f"_n_{f}")) & (F.coalesce(F.trim(f"_n_{d}"), F.lit("")) == ""), F.lit(f"{names[f]} needs {names[d]}")) for f, d in form.marks.items()]),
    ]
    x = x.select("*", *(F.sort_array(s).alias(f"_s{i}") for i, s in enumerate(steps)))
    errors = reduce(lambda rest, i: F.when(F.size(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(rest), reversed(range(len(steps))), F.array().cast("array<string>"))
    x = x.withColumn("errors", F.when(given.isNotNull(), errors).otherwise(F.array().cast("array<string>")))
    done = given.isNotNull() & (F.size("errors") == 0)
    before = [c for c in stored.columns if c != key]
    y = x.select(key, "errors", done.alias("_done"), *(F.col(c).alias(f"_o_{c}") for c in before), *(f"_in_{c}" for c in names), *(F.when(done, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in names), *(c for c in before if c not in names))

    have = set(stored.columns)
    fresh: dict[str, Column] = {}
    for prefix, (d, i, children) in SUMS.items():
        if all(f"{prefix}{s}_{k}" in have for s in ("mfc" if children else "mf") for k in "di"):
            fresh |= {c: v for c, v in zip((d, i), pair_totals(prefix, children), strict=True) if c in have}
    if "total_con" in have and all(b in have for b in BUILDERS):
        fresh["total_con"] = true_count(*map(F.col, BUILDERS))
    kinds = dict(stored.dtypes)
    y = y.withColumns({c: F.when(F.col("_done"), v.cast(kinds[c])).otherwise(F.col(c)) for c, v in fresh.items()})
    totals = {"total_deaths": null_sum(*(F.col(c) for c in (deaths, *TOTAL_DEATHS) if c in have)), "total_injuries": null_sum(*(F.col(c) for c in (injuries, *TOTAL_INJURIES) if c in have))}
    y = y.withColumns({c: F.when(F.col("_done"), v.cast(kinds[c])).otherwise(F.col(c)) for c, v in totals.items()})

    moved = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in totals))
    tracked = [(names[c], c, form.kinds[c], F.col(f"_in_{c}")) for c in names] + [(field_name(c), c, "count", F.lit(True)) for c in fresh if field_name(c) in COMPUTED]
    entries = [F.when(F.col("_done") & seen & ~F.col(c).eqNullSafe(F.col(f"_o_{c}")), F.struct(F.lit(n).alias("k"), _shown(F.col(f"_o_{c}"), kind).alias("old"), _shown(F.col(c), kind).alias("new"))) for n, c, kind, seen in tracked]
    entries += [F.when(F.col("_done") & moved, F.struct(F.lit(c).alias("k"), F.col(f"_o_{c}").cast("string").alias("old"), F.col(c).cast("string").alias("new"))) for c in totals]
    y = y.withColumn("_c", F.filter(F.array(*entries), lambda m: m.isNotNull()))
    side = lambda s: F.map_from_entries(F.transform("_c", lambda m: F.struct(m["k"], m[s])))
    return y.select(*stored.columns, "errors", side("old").alias("old_values"), side("new").alias("new_values"))
