"""A cursor-paginated feed as a streaming source: the offset is the last id read, so the checkpoint holds the cursor. Its records, and those that a provider pushes, become canonical rows."""

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "external_message_id string, source_platform string, source_name string, origin_platform string, origin_account string, classification map<string,string>, raw_text string, raw_payload string, message_datetime string"
# The keys of an upstream classification that are kept when present.
CLASSIFICATION_KEYS = ("include", "confidence", "event_domain", "event_subtype", "location", "location_in_lebanon", "is_commentary_or_analysis", "mentions_israeli_actor", "is_realtime", "reason")
# The feed's field for each canonical column.
FIELDS = {"source_platform": "source_platform", "source_name": "source_name", "origin_platform": "source_platform", "origin_account": "source_name", "raw_text": "post_text", "message_datetime": "post_date"}


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def normalize(record: dict) -> tuple:
    """A provider's record as a canonical row. The id is the feed's number, not its external_id; a classification key that is present stays even with a null value, and without any the classification is null; values other than strings are JSON."""
    known = {k: _text(record[k]) for k in CLASSIFICATION_KEYS if k in record} or None
    row = {"external_message_id": str(record["id"]), "classification": known, "raw_payload": json.dumps(record, ensure_ascii=False)} | {k: _text(record.get(v)) for k, v in FIELDS.items()}
    return tuple(row[c.split()[0]] for c in SCHEMA.split(", "))


def records(bodies: DataFrame, body: str) -> DataFrame:
    """(record): the JSON records of pushed bodies, each an object or an array of objects."""
    listed = F.when(F.ltrim(body).startswith("["), F.col(body)).otherwise(F.concat(F.lit("["), F.col(body), F.lit("]")))
    return bodies.select(F.explode(F.from_json(listed, "array<string>")).alias("record"))


def normalized(rows: DataFrame, record: str) -> DataFrame:
    """normalize() over a column of JSON records, as Columns."""
    known = F.map_filter(F.from_json(record, "map<string,string>"), lambda k, v: k.isin(*CLASSIFICATION_KEYS))
    got = {k: F.get_json_object(record, f"$.{v}") for k, v in FIELDS.items()}
    got |= {"external_message_id": F.get_json_object(record, "$.id"), "classification": F.when(F.size(known) > 0, known), "raw_payload": F.col(record)}
    return rows.select(*(got[c.split()[0]].alias(c.split()[0]) for c in SCHEMA.split(", ")))


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, fetch: Callable, start: int):
        self.fetch, self.start = fetch, start

    def initialOffset(self):
        return {"after": self.start}

    def read(self, start):
        items, after = self.fetch(start["after"], 500)
        return iter([normalize(x) for x in items]), {"after": after}

    def readBetweenOffsets(self, start, end):
        after = start["after"]
        while after < end["after"]:
            items, after = self.fetch(after, 500)
            yield from (normalize(x) for x in items)

    def commit(self, end):
        pass


def feed(name: str, fetch: Callable[[int, int], tuple[list[dict], int]], start: int = 0) -> type[DataSource]:
    """A data source class for spark.dataSource.register: fetch(after_id, limit) gives (records, next id)."""

    class Feed(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def simpleStreamReader(self, schema: StructType):
            return _Reader(fetch, start)

    return Feed


def resume_cursor(ids):
    """The largest id that is a plain number, as a Column aggregate."""
    return F.max(F.when(ids.rlike("^[0-9]+$"), ids.try_cast("bigint")))
