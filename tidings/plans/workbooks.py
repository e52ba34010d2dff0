"""Tables to workbooks and back."""

from pyspark.sql import functions as F

from tidings.plans.registry import query
from tidings.sources import workbook
from tidings.sources.tables import table as t
from tidings.streaming.streams import folder


@query(f"""SELECT (row_number() OVER (ORDER BY p_partkey) - 1) % {workbook.FULL - 1} + 2 AS row_, CAST(p_partkey AS VARCHAR) AS a, p_name AS a__2, CAST(p_size AS VARCHAR) AS Column_3, p_type AS b, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS a__3, CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END AS Column_6 FROM part""")
def header_dedupe(spark, sf):
    """Parts written as a workbook under headers that repeat or are blank, and read again under unique ones. Rows bear their numbers in their sheet (from 2): a full sheet ends, and the next workbook begins anew."""
    path = folder(spark)
    part = t(spark, sf, "part").orderBy("p_partkey").select("p_partkey", "p_name", "p_size", "p_type", F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")), F.col("p_partkey") % 2 == 0)
    workbook.export(part.coalesce(1), path, ["a", "a ", "", "b", "a", None])
    return workbook.scan(spark, path).withColumnRenamed("_row", "row_").drop("_file")


_ACTIONS = [(35, "Warplanes", "طيران حربي"), (36, "Drone", "مسيرة"), (38, "Helicopter", "مروحية")]


@query("""SELECT o_orderkey, CASE WHEN error IS NULL THEN c END AS condition_id, CASE WHEN error IS NULL THEN CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%B') ELSE 'May' END END AS month, CASE WHEN o_orderkey % 5 = 0 THEN 'Manual import' ELSE o_orderpriority END AS source,
 CASE WHEN error IS NULL THEN CAST(o_orderdate AS DATE) END AS day, error FROM (SELECT *, CASE WHEN c IS NULL THEN 'unknown action' WHEN o_orderkey % 11 = 3 THEN 'no date' END AS error FROM
 (SELECT *, CASE o_orderkey % 8 WHEN 0 THEN 35 WHEN 1 THEN 36 WHEN 2 THEN 38 WHEN 3 THEN 36 WHEN 4 THEN 35 WHEN 5 THEN 38 END AS c FROM orders))""")
def violations_import(spark, sf):
    """Orders as violation sheets, several files with the columns in another order, dates as dates; actions in either language, unknown ones and missing dates set aside as errors."""
    k = F.col("o_orderkey")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % 8 + 1).cast("int"))
    columns = {
        "Link": k.cast("string"), "Note 2": F.lit(None).cast("string"), "Action_A": pick(["", "", "", "مسيرة", "طيران حربي", " مروحية ", "لا", None]), "Source": F.when(k % 5 != 0, F.col("o_orderpriority")), "Caza": F.lit("x"),
        "Date": F.when(k % 11 != 3, F.to_date("o_orderdate")), "Time": F.lit("10:00"), "Khabar": F.col("o_orderstatus"), "Month": F.when(k % 4 != 0, "May"), "Action_E": pick([" WARPLANES", "drone", "Helicopter", "what", None, "", "?", None]), "Note 1": F.lit("a <b> & \u0001"),
    }
    path = folder(spark)
    workbook.export(t(spark, sf, "orders").select(*(c.alias(n) for n, c in columns.items())), path)
    sheet = workbook.scan(spark, path, workbook.VIOLATION_HEADERS)
    got = workbook.violations(sheet, spark.createDataFrame(_ACTIONS, "condition_id int, action_en string, action_ar string"))
    return got.select(F.col("link").cast("long").alias("o_orderkey"), "condition_id", "month", "source", "day", "error")
