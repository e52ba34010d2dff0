"""Details in two tiers, assembled, widened and filled into stored rows."""

from pyspark.sql import functions as F

from tidings.operators import details
from tidings.plans.registry import query
from tidings.sources.tables import table as t


def _category(did=None, name=None, **counts):
    null = lambda kind: F.lit(None).cast(kind)
    casualties = F.struct(*(counts.get(c, null("int")).cast("int").alias(c) for c in details.COUNTS))
    return F.struct((null("string") if did is None else did).alias("did"), (null("string") if name is None else name).alias("name"), casualties.alias("casualties"), F.lit(None).alias("vehicles")).cast(details.CATEGORY)


@query("""WITH x AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS la1, o_orderkey % 4 = 0 AS la2, o_orderkey % 5 > 1 AS hos, o_orderkey % 3 = 0 AS pr, CASE WHEN o_orderkey % 6 <> 5 THEN o_orderkey % 4 END AS rd FROM orders),
 y AS (SELECT *, CASE WHEN la2 THEN 9 WHEN la1 THEN k % 3 END AS la_td, CASE WHEN hos THEN k % 4 END AS hd FROM x)
 SELECT k AS o_orderkey, concat_ws(',', CASE WHEN rd IS NOT NULL THEN 'casualty_demographics' END, CASE WHEN hos THEN 'hospital' END, CASE WHEN la1 THEN 'lebanese_army' END, CASE WHEN pr THEN 'press' END) AS keys,
  CASE WHEN k % 5 = 0 THEN 'hospital' ELSE '' END AS failed, CASE WHEN k % 5 = 1 THEN 'hospital' ELSE '' END AS empty, CASE WHEN la1 THEN true WHEN k % 10 = 1 THEN false END AS la, CASE WHEN la2 THEN 'I' WHEN la1 THEN 'D' END AS la_did,
  CASE WHEN k % 7 = 0 THEN 'old' WHEN hos THEN 'H' || k % 7 END AS hos_n, greatest(CASE WHEN k % 2 = 1 THEN 2 END, hd) AS hosd, CASE WHEN pr THEN 2 END AS pressi,
  CASE WHEN coalesce(rd, la_td, hd) IS NOT NULL THEN coalesce(rd, 0) + coalesce(la_td, 0) + coalesce(hd, 0) END AS total_deaths, CASE WHEN pr THEN 2 END AS total_injuries FROM y""")
def tiered_details(spark, sf):
    """Orders as messages: an army category of the first tier, hospital, press and army details of the second, of which some failed or are empty; root counts; then the wide fields filled into stored rows."""
    k = F.col("o_orderkey")
    o = t(spark, sf, "orders").select("o_orderkey")
    root = F.struct(*((F.when(k % 6 != 5, k % 4).cast("int") if c == "deaths" else F.lit(None).cast("int")).alias(c) for c in details.COUNTS))
    first = F.when(k % 2 == 0, F.create_map(F.lit("lebanese_army"), _category(F.lit("D"), male_deaths=k % 3)))
    hospital = F.when(k % 5 == 1, _category()).when(k % 5 > 1, _category(F.lit("I"), F.concat(F.lit("H"), (k % 7).cast("string")), male_deaths=k % 4))
    asked = [
        (F.lit("hospital"), hospital, F.when(k % 5 == 0, "timeout"), F.lit(True)),
        (F.lit("press"), _category(name=F.lit("P"), female_injuries=F.lit(2)), F.lit(None).cast("string"), k % 3 == 0),
        (F.lit("lebanese_army"), _category(F.lit("I"), male_deaths=F.lit(9)), F.lit(None).cast("string"), k % 4 == 0),
    ]
    rows = [o.where(when).select("o_orderkey", key.alias("key"), detail.alias("detail"), error.alias("error")) for key, detail, error, when in asked]
    answers = rows[0].unionByName(rows[1]).unionByName(rows[2])
    got = details.assemble(o.select("o_orderkey", first.alias("c"), root.alias("root")), "o_orderkey", "c", "root", answers, "key", "detail", "error")
    list_ = lambda c: F.array_join(F.sort_array(c), ",")
    # what is told of a message travels with it, so that nothing is assembled or joined twice
    told = got.withColumns({"keys": list_(F.map_keys("categories")), "failed": list_(F.col("failed")), "empty": list_(F.col("empty"))})
    wide = details.widen(told, "o_orderkey", "categories", "root", ["keys", "failed", "empty"])
    none = lambda kind: F.lit(None).cast(kind)
    stored = o.select(
        "o_orderkey", *(none("string").alias(c) for c in ("keys", "failed", "empty")), F.when(k % 10 == 1, F.lit(False)).alias("la"), none("string").alias("la_did"), F.when(k % 7 == 0, "old").alias("hos_n"), F.when(k % 2 == 1, 2).alias("hosd"),
        none("int").alias("pressi"), none("int").alias("total_deaths"), none("int").alias("total_injuries"),
    )
    return details.fill(stored, wide, ["o_orderkey"])
