"""Workbooks (zipped XML sheets) as tables: a scan, a writer with commit and abort, and the import of one sheet layout.

Files come through Spark's own binary scan, so they may lie wherever Spark reads, and are parsed row by row in the tasks, one
file a task at a time: a zipped sheet can only be read from its start. The writer makes one workbook a partition, more where a
sheet is full, first under temporary names that the commit renames.
"""

import datetime
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidings.functions.values import coerce_date
from tidings.sources.tables import require, unique_headers

FULL = 1_048_576  # rows of a sheet
_DAY0 = datetime.datetime(1899, 12, 30)
_DATES = {*range(14, 23), *range(45, 48)}  # built-in number formats of dates and times
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0d\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_CODED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _parts(content: bytes, name: str) -> Iterator:
    """The elements of a part of the file as they end, none if it lacks the part."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if name in z.namelist():
            with z.open(name) as f:
                yield from (e for _, e in iterparse(f))


def _said(element) -> str:
    """The text below an element without phonetic marks."""
    out = [t.text or "" for r in element if _name(r.tag) != "rPh" for t in r.iter() if _name(t.tag) == "t"]
    return _CODED.sub(lambda m: chr(int(m[1], 16)), "".join(out))


def _date_styles(content: bytes) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    formats, out, n = set(_DATES), set(), 0
    for e in _parts(content, "xl/styles.xml"):
        if _name(e.tag) == "numFmt" and re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "").lower())):
            formats.add(int(e.get("numFmtId")))
        if _name(e.tag) == "cellXfs":
            for n, x in enumerate(e):
                if int(x.get("numFmtId", 0)) in formats:
                    out.add(n)
    return out


def _moment(serial: float) -> str:
    at = _DAY0 + datetime.timedelta(milliseconds=round(serial * 86_400_000))
    if serial < 1:
        return at.time().isoformat()
    return at.date().isoformat() if serial == int(serial) else at.isoformat(sep=" ")


def _first_sheet(content: bytes) -> str:
    target = {e.get("Id"): e.get("Target", "") for e in _parts(content, "xl/_rels/workbook.xml.rels") if _name(e.tag) == "Relationship"}
    for e in _parts(content, "xl/workbook.xml"):
        if _name(e.tag) == "sheet":
            link = next((v for k, v in e.attrib.items() if _name(k) == "id"), None)
            return "xl/" + target.get(link, "worksheets/sheet1.xml").removeprefix("/xl/").removeprefix("xl/")
    return "xl/worksheets/sheet1.xml"


def _place(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = 26 * n + ord(c.upper()) - 64
    return n - 1


def rows_of(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells as text) of the first sheet, empty rows at their numbers left out. Numbers without a fraction have none; dates and times are ISO."""
    shared, dates = [_said(e) for e in _parts(content, "xl/sharedStrings.xml") if _name(e.tag) == "si"], _date_styles(content)
    number = 0
    for e in _parts(content, _first_sheet(content)):
        if _name(e.tag) != "row":
            continue
        number, cells = int(e.get("r", number + 1)), []
        for c in e:
            at = _place(c.get("r")) if c.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            kind, value = c.get("t", "n"), next((v.text for v in c if _name(v.tag) == "v"), None)
            if kind == "inlineStr":
                cells[at] = next((_said(i) for i in c if _name(i.tag) == "is"), "")
            elif value is None:
                continue
            elif kind == "s":
                cells[at] = shared[int(value)]
            elif kind == "b":
                cells[at] = "true" if value == "1" else "false"
            elif kind == "n":
                x = float(value)
                cells[at] = _moment(x) if int(c.get("s", 0)) in dates else str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)
            else:
                cells[at] = _CODED.sub(lambda m: chr(int(m[1], 16)), value)
        e.clear()
        if cells:
            yield number, cells


def scan(spark: SparkSession, path: str, required: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """The first sheets of all workbooks at a path, cells as text, under the unique headers of the first file in order of name; _file and _row tell where a row stood (data from 2). Rows of blanks go. Other files may have the headers in another order; one that lacks some, and required ones that are missing, are errors."""
    files = spark.read.format("binaryFile").load(path)

    def heads(batches):
        import pyarrow as pa

        for batch in batches:
            got = [next((c for n, c in rows_of(b) if n == 1), []) for b in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(got, pa.list_(pa.string()))], ["path", "cells"])

    first = files.select("path", "content").mapInArrow(heads, "path string, cells array<string>").orderBy("path").first()
    names = unique_headers(first["cells"]) if first else list(required)
    require(spark.createDataFrame([], ", ".join(f"`{n.replace('`', '``')}` string" for n in names)) if names else spark.range(0), list(required))

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                own, held = None, []
                for n, cells in rows_of(content):
                    if own is None:
                        own = unique_headers(cells) if n == 1 else []
                        lost = sorted(set(names) - set(own))
                        if lost:
                            raise ValueError(f"{file}: missing columns: " + ", ".join(lost))
                        places = [own.index(c) for c in names]
                        continue
                    values = [cells[p] if p < len(cells) else None for p in places]
                    if any((v or "").strip() for v in values):
                        held.append([file, n, *values])
                    if len(held) == 5000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    def _batch(held):
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), *[pa.string()] * len(names)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], [f"c{k}" for k in range(len(kinds))])

    schema = ", ".join(["c0 string", "c1 long", *(f"c{k + 2} string" for k in range(len(names)))])
    return files.select("path", "content").mapInArrow(rows, schema).toDF("_file", "_row", *names)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[tuple[str, str]]):
        self.names = names


class _Writer(DataSourceWriter):
    def __init__(self, path: str, headers: list[str], full: int, overwrite: bool):
        self.path, self.headers, self.full, self.overwrite = path, headers, full, overwrite
        self.run = uuid.uuid4().hex[:8]

    def _fs(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path)

    def _cell(self, x) -> str:
        if x is None:
            return "<c/>"
        if isinstance(x, bool):
            return f'<c t="b"><v>{int(x)}</v></c>'
        if isinstance(x, (int, float)):
            return f"<c><v>{x!r}</v></c>" if x == x and abs(x) != float("inf") else "<c/>"
        if isinstance(x, datetime.datetime):
            return f'<c s="2"><v>{(x.replace(tzinfo=None) - _DAY0) / datetime.timedelta(days=1)!r}</v></c>'
        if isinstance(x, datetime.date):
            return f'<c s="1"><v>{(x - _DAY0.date()).days}</v></c>'
        text = _CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", str(x))
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    def _book(self, stream, rows) -> None:
        """A workbook of one sheet: headers, then at most full - 1 rows."""
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        rels = lambda links: f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{n}" Type="{office}/{t}" Target="{to}"/>' for n, (t, to) in enumerate(links, 1)) + "</Relationships>"
        with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
                       f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>')  # fmt: skip
            z.writestr("_rels/.rels", rels([("officeDocument", "xl/workbook.xml")]))
            z.writestr("xl/_rels/workbook.xml.rels", rels([("worksheet", "worksheets/sheet1.xml"), ("styles", "styles.xml")]))
            z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
            xf = "".join(f'<xf numFmtId="{n}" applyNumberFormat="1"/>' for n in (0, 14, 22))
            z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3">{xf}</cellXfs></styleSheet>')
            with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
                for row in rows:
                    f.write(("<row>" + "".join(map(self._cell, row)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")

    def write(self, iterator):
        from pyspark import TaskContext

        fs, base = self._fs()
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        names, left = [], iter(iterator)
        row = next(left, None)
        while row is not None or not names:

            def rows():
                nonlocal row
                yield self.headers
                for _ in range(self.full - 1):
                    if row is None:
                        return
                    yield tuple(row)
                    row = next(left, None)

            final = f"part-{task.partitionId():05d}-{len(names):03d}.xlsx"
            temp = f"_{self.run}-{task.taskAttemptId()}-{final}"
            with fs.open_output_stream(f"{base}/{temp}") as out:
                self._book(out, rows())
            names.append((temp, final))
        return _Written(names)

    def commit(self, messages):
        fs, base = self._fs()
        if self.overwrite:
            from pyarrow.fs import FileSelector

            for f in fs.get_file_info(FileSelector(base)):
                if f.base_name.startswith("part-"):
                    fs.delete_file(f.path)
        for temp, final in (n for m in messages if m for n in m.names):
            fs.move(f"{base}/{temp}", f"{base}/{final if self.overwrite else self.run + '-' + final}")

    def abort(self, messages):
        fs, base = self._fs()
        for temp, _ in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{base}/{temp}")


class Workbooks(DataSource):
    """df.write.format("tidings_workbook"): workbooks in a folder that driver and executors reach under the same address. Options: path; headers, a JSON list in place of the column names; full, the rows of a sheet."""

    @classmethod
    def name(cls):
        return "tidings_workbook"

    def writer(self, schema, overwrite):
        import json

        headers = json.loads(self.options["headers"]) if "headers" in self.options else schema.names
        return _Writer(self.options["path"], headers, int(self.options.get("full", FULL)), overwrite)


def export(df: DataFrame, path: str, headers: list[str | None] | None = None, full: int = FULL) -> None:
    """Writes a table as workbooks, in place of those there. Order df for order: the parts' names follow its partitions."""
    import json

    spark = df.sparkSession
    spark.dataSource.register(Workbooks)
    w = df.write.format("tidings_workbook").mode("overwrite").option("path", path).option("full", full)
    (w if headers is None else w.option("headers", json.dumps(headers))).save()


# The headers of a violations sheet.
VIOLATION_HEADERS = ("Caza", "Month", "Action_E", "Action_A", "Khabar", "Source", "Time", "Date", "Note 1", "Note 2", "Link")
NO_SOURCE = "Manual import"


def violations(sheet: DataFrame, actions: DataFrame) -> DataFrame:
    """(row, condition_id, caza, month, source, day, clock, text, note_1, note_2, link, error) of a violations sheet. actions: (condition_id, action_en, action_ar); the English action decides, then the other, without regard to case and blanks around. A row without a known action or date bears an error. A missing month is the date's, a missing source one of its own."""
    cell = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    def key(x: Column) -> Column:
        return F.lower(F.trim(x))

    en = actions.groupBy(key(F.col("action_en")).alias("_e")).agg(F.max("condition_id").alias("_ce"))
    ar = actions.groupBy(key(F.col("action_ar")).alias("_a")).agg(F.max("condition_id").alias("_ca"))
    x = require(sheet, list(VIOLATION_HEADERS)).withColumns({"_e": key(F.col("Action_E")), "_a": key(F.col("Action_A"))}).join(en, "_e", "left").join(ar, "_a", "left")
    condition, day = F.coalesce("_ce", "_ca"), coerce_date(cell("Date"))
    error = F.when(condition.isNull(), "unknown action").when(day.isNull(), "no date")
    ok = error.isNull()
    return x.select(
        F.col("_row").alias("row"), F.when(ok, condition).alias("condition_id"), cell("Caza").alias("caza"), F.when(ok, F.coalesce(cell("Month"), F.date_format(day, "MMMM"))).alias("month"),
        F.coalesce(cell("Source"), F.lit(NO_SOURCE)).alias("source"), F.when(ok, day).alias("day"), cell("Time").alias("clock"), F.coalesce(cell("Khabar"), F.lit("")).alias("text"),
        cell("Note 1").alias("note_1"), cell("Note 2").alias("note_2"), cell("Link").alias("link"), error.alias("error"),
    )
