"""Edits of wide rows."""

from pyspark.sql import functions as F

from tidings.operators import edits
from tidings.plans.registry import query
from tidings.sources.tables import table as t

# eight edits in turn: a mark and a count, a flag with all it needs, a flag cleared beside a count, a computed field, an unknown one, texts of no kind, an empty mark, a flag cleared with its count
_EDITS = (
    {"la_did": "indirect", "lam_d": " 7 "},
    {"la": "yes", "la_did": "d", "laf_d": "2"},
    {"la": "0", "lam_d": "3"},
    {"la_td": "4", "lam_d": "1"},
    {"zz": "1", "lam_d": "1"},
    {"la": "2", "lam_d": "-1"},
    {"la_did": "", "lam_d": "5"},
    {"la": "no", "lam_d": "0"},
)


def _cell(name: str) -> str:
    return "CASE k % 8 " + " ".join(f"WHEN {i} THEN '{e[name]}'" for i, e in enumerate(_EDITS) if name in e) + " END"


_SHOWN = "array_to_string(list_sort(list_filter([CASE WHEN ok AND {0} IS NOT NULL AND nla IS DISTINCT FROM ola THEN 'la=' || coalesce(CAST(CAST({1}la AS INT) AS VARCHAR), '-') END, CASE WHEN ok AND {2} IS NOT NULL AND nmark IS DISTINCT FROM omark THEN 'la_did=' || coalesce({1}mark, '-') END, CASE WHEN ok AND {3} IS NOT NULL AND nm IS DISTINCT FROM om THEN 'lam_d=' || coalesce(CAST({1}m AS VARCHAR), '-') END, CASE WHEN ok AND {4} IS NOT NULL AND nf IS DISTINCT FROM of_ THEN 'laf_d=' || coalesce(CAST({5} AS VARCHAR), '-') END, CASE WHEN ok AND ntd IS DISTINCT FROM otd THEN 'la_td=' || coalesce(CAST({1}td AS VARCHAR), '-') END, CASE WHEN ok AND ntotal IS DISTINCT FROM ototal THEN 'total_deaths=' || coalesce(CAST({1}total AS VARCHAR), '-') END, CASE WHEN ok AND ntotal IS DISTINCT FROM ototal THEN 'total_injuries=-' END], lambda s: s IS NOT NULL)), ',')"


@query(f"""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderkey % 3 = 0 END AS ola, CASE WHEN o_orderkey % 3 = 0 THEN 'D' END AS omark, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 END AS om, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN o_orderkey % 4 END AS of_, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 7 END AS deaths FROM orders),
 a AS (SELECT *, coalesce(om + coalesce(of_, 0), of_) AS otd FROM o), b AS (SELECT *, CASE WHEN deaths IS NOT NULL OR otd IS NOT NULL THEN coalesce(deaths, 0) + coalesce(otd, 0) END AS ototal, {_cell("la")} AS ela, {_cell("la_did")} AS emark, {_cell("lam_d")} AS em, {_cell("laf_d")} AS ef, {_cell("la_td")} AS etd, {_cell("zz")} AS ez FROM a),
 c AS (SELECT *, CASE WHEN ela IS NULL THEN ola WHEN lower(ela) IN ('1', 'true', 'yes') THEN true WHEN lower(ela) IN ('', '0', 'false', 'no') THEN false END AS vla, CASE WHEN emark IS NULL THEN omark WHEN lower(emark) IN ('d', 'direct') THEN 'D' WHEN lower(emark) IN ('id', 'indirect') THEN 'ID' END AS vmark,
  CASE WHEN em IS NULL THEN om WHEN regexp_full_match(trim(em), '[0-9]+') THEN CAST(trim(em) AS BIGINT) END AS vm, CASE WHEN ef IS NULL THEN of_ WHEN regexp_full_match(trim(ef), '[0-9]+') THEN CAST(trim(ef) AS BIGINT) END AS vf FROM b),
 d AS (SELECT *, CASE WHEN k % 9 = 8 THEN '' WHEN etd IS NOT NULL THEN 'computed field: la_td' WHEN ez IS NOT NULL THEN 'unknown field: zz' WHEN ela IS NOT NULL AND vla IS NULL OR em IS NOT NULL AND vm IS NULL THEN concat_ws('; ', CASE WHEN ela IS NOT NULL AND vla IS NULL THEN 'la is no flag' END, CASE WHEN em IS NOT NULL AND vm IS NULL THEN 'lam_d is no count' END)
  WHEN emark IS NOT NULL AND vla IS NOT TRUE THEN 'la_did needs la' WHEN ela IS NOT NULL AND vla IS FALSE AND em IS NOT NULL AND vm > 0 THEN 'la is cleared, not lam_d' WHEN vla AND coalesce(vmark, '') = '' THEN 'la needs la_did' ELSE '' END AS errors FROM c),
 f AS (SELECT *, errors = '' AND k % 9 <> 8 AS ok FROM d),
 g AS (SELECT *, CASE WHEN ok THEN vla ELSE ola END AS nla, CASE WHEN ok THEN vmark ELSE omark END AS nmark, CASE WHEN ok THEN vm ELSE om END AS nm, CASE WHEN ok THEN vf ELSE of_ END AS nf FROM f),
 h AS (SELECT *, CASE WHEN ok THEN coalesce(nm + coalesce(nf, 0), nf) ELSE otd END AS ntd FROM g), i AS (SELECT *, CASE WHEN ok THEN CASE WHEN deaths IS NOT NULL OR ntd IS NOT NULL THEN coalesce(deaths, 0) + coalesce(ntd, 0) END ELSE ototal END AS ntotal FROM h)
 SELECT k AS o_orderkey, errors, nla AS la, nmark AS la_did, nm AS lam_d, nf AS laf_d, ntd AS la_td, ntotal AS total_deaths, {_SHOWN.format("ela", "o", "emark", "em", "ef", "of_")} AS old_values, {_SHOWN.format("ela", "n", "emark", "em", "ef", "nf")} AS new_values FROM i""")
def row_edits(spark, sf):
    """Edits of stored rows: refused with their errors, or applied with sums, totals and what changed; one row in nine has no edit."""
    k = F.col("o_orderkey")
    on = k % 3 == 0
    rows = t(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 3 != 2, on).alias("la"),
        F.when(on, "D").alias("la_did"),
        *(F.when(c, v).cast("int").alias(n) for n, c, v in (("lam_d", on, k % 5), ("laf_d", on & (k % 2 == 0), k % 4), ("lam_i", F.lit(False), k), ("laf_i", F.lit(False), k), ("deaths", k % 5 != 0, k % 7), ("injuries", F.lit(False), k))),
    )
    rows = rows.withColumns({"la_td": F.coalesce(F.col("lam_d") + F.coalesce("laf_d", F.lit(0)), "laf_d"), "la_ti": F.lit(None).cast("int"), "total_injuries": F.lit(None).cast("int")})
    rows = rows.withColumn("total_deaths", F.when(F.coalesce("deaths", "la_td").isNotNull(), F.coalesce("deaths", F.lit(0)) + F.coalesce("la_td", F.lit(0))))
    choices = F.array(*(F.map_from_arrays(F.array(*map(F.lit, e)), F.array(*map(F.lit, e.values()))) for e in _EDITS))
    wanted = t(spark, sf, "orders").where("o_orderkey % 9 <> 8").select("o_orderkey", F.get(choices, (k % 8).cast("int")).alias("edit"))
    said = lambda m: F.array_join(F.sort_array(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))))), ",")
    x = edits.apply_edits(rows, wanted, "o_orderkey", "edit")
    return x.select("o_orderkey", F.array_join("errors", "; ").alias("errors"), "la", "la_did", "lam_d", "laf_d", "la_td", "total_deaths", said("old_values").alias("old_values"), said("new_values").alias("new_values"))
