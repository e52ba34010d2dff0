"""Workbooks: round trips of every kind of value, sheets by other writers, full sheets, missing columns, an aborted write."""

import datetime
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tidings.sources import workbook

D = datetime.date(2024, 2, 29)
AT = datetime.datetime(2024, 2, 29, 13, 5, 7)
ROWS = [
    (1, "a", 1.5, True, D, AT), (2, None, None, None, None, None), (-(10**14), " <b>&\"' \t\n_x0041_ \u0001\r é中😀 ", 1e300, False, datetime.date(1900, 3, 1), datetime.datetime(1999, 12, 31, 23, 59, 59)), (None, "", float("nan"), None, None, None),
    (None, None, None, None, None, None), (7, "x" * 40_000, 0.1, True, D, AT.replace(microsecond=500_000)),
]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "n long, s string, x double, f boolean, d date, t timestamp_ntz")
    workbook.export(df.coalesce(1), str(tmp_path), ["n", "n", None, " ", "n ", "t"])
    got = [tuple(r) for r in workbook.scan(spark, str(tmp_path), ["t", "n__3"]).orderBy("_row").drop("_file").collect()]
    assert got == [
        (2, "1", "a", "1.5", "true", "2024-02-29", "2024-02-29 13:05:07"), (3, "2", None, None, None, None, None),
        (4, "-100000000000000", ROWS[2][1], "1e+300", "false", "1900-03-01", "1999-12-31 23:59:59"), (7, "7", "x" * 40_000, "0.1", "true", "2024-02-29", "2024-02-29 13:05:07.500000"),
    ]
    assert workbook.scan(spark, str(tmp_path)).columns == ["_file", "_row", "n", "n__2", "Column_3", "Column_4", "n__3", "t"]
    with pytest.raises(ValueError, match="missing columns: w, z"):
        workbook.scan(spark, str(tmp_path), ["z", "t", "w"])


def test_full_sheets_and_order(spark, tmp_path):
    workbook.export(spark.range(95).orderBy(F.desc("id")).coalesce(1), f"file://{tmp_path}", full=31)
    assert len(os.listdir(tmp_path)) == 4
    rows = workbook.scan(spark, str(tmp_path)).orderBy("_file", "_row").collect()
    assert [int(r["id"]) for r in rows] == list(range(94, -1, -1)) and max(r["_row"] for r in rows) == 31
    workbook.export(spark.range(3), str(tmp_path))
    assert workbook.scan(spark, str(tmp_path)).count() == 3
    workbook.export(spark.range(0), str(tmp_path))
    assert workbook.scan(spark, str(tmp_path)).count() == 0


def test_a_failed_write_leaves_the_old_files(spark, tmp_path):
    workbook.export(spark.range(5), str(tmp_path))
    before = sorted(os.listdir(tmp_path))
    with pytest.raises(Exception, match="broken"):
        workbook.export(spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("id")), str(tmp_path))
    assert [f for f in sorted(os.listdir(tmp_path)) if f.startswith("part-")] == before and workbook.scan(spark, f"{tmp_path}/part-*").count() == 5


def test_the_sql_numbers_rows_by_sheet(tmp_path):
    """Rows beyond a full sheet stand in the next workbook, from row 2 on."""
    import duckdb

    from tidings import plans

    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT i AS p_partkey, 'n' AS p_name, 1 AS p_size, 't' AS p_type, 'b' AS p_brand FROM range({workbook.FULL + 1}) r(i)")
    got = c.execute(f"SELECT a, row_ FROM ({plans.ORACLES['header_dedupe']}) WHERE CAST(a AS BIGINT) IN (0, {workbook.FULL - 2}, {workbook.FULL - 1}, {workbook.FULL}) ORDER BY CAST(a AS BIGINT)").fetchall()
    assert [n for _, n in got] == [2, workbook.FULL, 2, 3]


def other(path, sheet, **more):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="x" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId9" Target="/xl/worksheets/other.xml"/></Relationships>')
        z.writestr("xl/worksheets/other.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
        for name, text in more.items():
            z.writestr(f"xl/{name}.xml", text.replace("<root", f"<root {main}"))


def test_sheets_of_other_writers(spark, tmp_path):
    """Shared strings with runs and phonetic marks, cells left out, formulas, errors, own date formats, other column orders."""
    shared = "<root><si><t>b</t></si><si><r><t>a</t></r><r><t> </t></r></si><si><t>東</t><rPh><t>ひ</t></rPh></si></root>"
    styles = '<root><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yy;@"/><numFmt numFmtId="165" formatCode="&quot;days&quot; 0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></root>'
    rows = '<row r="1"><c r="B1" t="s"><v>0</v></c><c r="A1" t="s"><v>1</v></c><c r="D1" t="str"><v>c</v></c></row><row r="4"><c r="D4" s="1"><v>45351</v></c><c r="B4" t="s"><v>2</v></c></row><row r="5"><c r="C5"/></row><row><c s="2"><f>1+1</f><v>2</v></c><c t="e"><v>#N/A</v></c></row>'
    other(f"{tmp_path}/1.xlsx", rows, sharedStrings=shared, styles=styles)
    other(f"{tmp_path}/2.xlsx", '<row><c t="inlineStr"><is><t>Column_3</t></is></c><c t="str"><v>c</v></c><c t="str"><v>a</v></c><c t="str"><v>b</v></c></row><row><c><v>1</v></c><c><v>2</v></c><c><v>3</v></c><c t="b"><v>1</v></c></row>')
    got = workbook.scan(spark, str(tmp_path)).orderBy("_file", "_row").collect()
    assert [tuple(r)[1:] for r in got] == [(4, None, "東", None, "2024-02-29"), (6, "2", "#N/A", None, None), (2, "3", "true", "1", "2")] and got[0].__fields__[2:] == ["a", "b", "Column_3", "c"]
    other(f"{tmp_path}/3.xlsx", '<row><c t="str"><v>a</v></c></row><row><c><v>1</v></c></row>')
    with pytest.raises(Exception, match="missing columns: Column_3, b, c"):
        workbook.scan(spark, str(tmp_path)).collect()
