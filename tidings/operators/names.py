"""Names in texts: each text is read once by a multi-pattern automaton (Aho-Corasick) that holds all names.

Names come to the workers as one broadcast of at most AUTOMATON_BYTES, measured first; a longer list is dealt by hash to as
many passes as it needs, each with a broadcast of that size, and what the passes find is put together. A text never explodes
into its words, and nothing is shuffled where one pass is enough.
"""

import unicodedata
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.functions.text import fold_alert, hashtags, latin_token

AUTOMATON_BYTES = 64 << 20
# Names that the places' own list lacks, with the code of the place that each means, first ones first.
ALIASES = (("عين بعال", 62243), ("وادي حيلو", 62218), ("دى حيلو", 62218), ("shahim", 23211), ("al bazuriya", 62246), ("al bazuriye", 62246))
# Hashtags that name no place.
NOT_PLACES = ("لبنان", "تحليق", "تحديث", "مسير", "مسيره", "مقاتلات حربيه", "طيران حربي", "اقصى درجات الحذر", "الخريطه المباشره")
LEAST_NAME, LEAST_LATIN = 3, 4
HOW = ("alias", "hashtag", "name", "latin")
_built: dict = {}


def automaton(words):
    import ahocorasick

    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out


def _inside(c: str) -> bool:
    return c == "_" or c.isalnum()


def bounded(found, text: str):
    """Of an automaton's hits those with no letter, digit or underscore on either side."""
    for end, w in found:
        start = end + 1 - len(w)
        if (start == 0 or not _inside(text[start - 1])) and (end + 1 == len(text) or not _inside(text[end + 1])):
            yield w


def latin_of(text: str) -> str:
    """functions.text.latin_token() of one text."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return "".join(c for c in plain if "a" <= c <= "z").replace("ch", "sh")


def passes(texts: DataFrame, patterns: DataFrame, key: str, build: Callable, search: Callable, schema: str, most: int = AUTOMATON_BYTES) -> tuple[DataFrame, int]:
    """texts through search(built, record batch), which yields record batches, where built = build(rows of patterns); and how often they were read. Patterns beyond `most` bytes come in several lots by hash of key."""
    size = patterns.agg(F.coalesce(F.sum(F.octet_length(key) + 64), F.lit(0))).first()[0]
    n, out = max(1, -(-size // most)), None
    for k in range(n):
        lot = patterns if n == 1 else patterns.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)
        sent, token = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in lot.collect()]), uuid.uuid4().hex

        def run(batches, sent=sent, token=token):
            if token not in _built:  # a worker keeps the last one only
                _built.clear()
                _built[token] = build(sent.value)
            for batch in batches:
                yield from search(_built[token], batch)

        one = texts.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out, n


def named_in(texts: DataFrame, id_: str, text: Column, names: DataFrame, name: str, longest: bool = False, most: int = AUTOMATON_BYTES) -> DataFrame:
    """(id, columns of names): the names, of any number of words and with any signs in them, that a text holds on word boundaries, each once a text; on demand only those than which the text holds no longer one. Null texts hold none; names without letters and digits are not found."""
    keys = names.where(F.rlike(name, F.lit(r"[\p{L}\p{N}]"))).select(F.col(name).alias("_name")).distinct()
    rows = texts.select(F.col(id_).alias("_id"), text.alias("_text"))

    def search(built, batch):
        ids, found = [], []
        for k, s in zip(range(batch.num_rows), batch.column("_text").to_pylist(), strict=True):
            hits = set(bounded(built.iter(s), s)) if s and len(built) else set()
            if longest and hits:
                length = max(map(len, hits))
                hits = {h for h in hits if len(h) == length}
            ids += [k] * len(hits)
            found += hits
        yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(ids, pa.int64())), pa.array(found, pa.string())], ["_id", "_name"])

    kind = dict(rows.dtypes)["_id"]
    got, n = passes(rows, keys, "_name", lambda rows: automaton(r[0] for r in rows), search, f"_id {kind}, _name string", most)
    if longest and n > 1:
        got = got.withColumn("_l", F.max(F.length("_name")).over(W.partitionBy("_id"))).where(F.length("_name") == F.col("_l")).drop("_l")
    out = got.withColumnRenamed("_id", id_).join(names, F.col("_name") == names[name])
    return out.select(id_, *names.columns)


def longest_name(found: DataFrame, id_: str, name: str, position: str) -> DataFrame:
    """Of the names found in each text the longest, ties to the first in list order."""
    w = W.partitionBy(id_).orderBy(F.length(name).desc(), position)
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _patterns(places: DataFrame, place_id: str, position: str, local: list[str], latin: list[str], code: str | None, aliases) -> DataFrame:
    """(kind, key, rank, place, label), one row a kind and key: the first place that bears it."""
    def listed(kind: str, columns: list[str], of: Callable, label: Callable) -> list[DataFrame]:
        rank = lambda n: (F.col(position) * len(columns) + n).cast("long").alias("rank")
        return [places.select(F.lit(kind).alias("kind"), of(F.col(c)).alias("key"), rank(n), F.col(place_id).cast("long").alias("place"), label(F.col(c)).alias("label")) for n, c in enumerate(columns)]

    parts = listed("name", local, fold_alert, fold_alert) + [p.where(F.length("key") >= LEAST_LATIN) for p in listed("latin", latin, latin_token, lambda c: c)]
    if code and aliases:
        table = places.sparkSession.createDataFrame([(n, a, c) for n, (a, c) in enumerate(aliases)], "rank long, label string, code long")
        first = places.where(F.col(code).isNotNull()).groupBy(F.col(code).cast("long").alias("code")).agg(F.min_by(F.col(place_id).cast("long"), F.col(position)).alias("place"))
        arabic = F.col("label").rlike(r"[\x{0600}-\x{06FF}]")
        kind, key = F.when(arabic, "alias").otherwise("latin_alias"), F.when(arabic, fold_alert(F.col("label"))).otherwise(latin_token(F.col("label")))
        parts.append(table.join(first, "code").select(kind.alias("kind"), key.alias("key"), "rank", "place", "label"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = F.min(F.struct("rank", "place", "label")).alias("first")
    return out.where("key <> ''").groupBy("kind", "key").agg(first).select("kind", "key", "first.*")


class _Places:
    """The patterns in a worker: an automaton of folded names and aliases, one of Latin ones."""

    def __init__(self, rows):
        self.of: dict = {}
        for kind, key, rank, place, label in rows:
            self.of[kind, key] = (rank, place, label)
        self.folded = automaton({k for kind, k in self.of if kind in ("name", "alias")})
        self.latin = automaton({k for kind, k in self.of if kind in ("latin", "latin_alias")})

    def best(self, folded: str, latin: str, tags: list[str]):
        """(how, first and second order, place, label) of the place that a text names, None if none."""
        hits = set(self.folded.iter(folded)) if len(self.folded) else set()
        low = {w for _, w in self.latin.iter(latin)} if len(self.latin) else set()
        of = lambda kind, words: [(w, self.of[kind, w]) for w in words if (kind, w) in self.of]
        said = of("alias", {w for _, w in hits}) + of("latin_alias", low)
        if said:
            rank, place, label = min(e for _, e in said)
            return 0, rank, 0, place, label
        for k, tag in enumerate(tags):
            if ("name", tag) in self.of:
                rank, place, _ = self.of["name", tag]
                return 1, k, rank, place, tag
        named = of("name", {w for w in bounded(hits, folded) if len(w) >= LEAST_NAME})
        for how, found in ((2, named), (3, of("latin", low))):
            if found:
                length, (rank, place, label) = min((-len(w), e) for w, e in found)
                return how, length, rank, place, label
        return None


def match_places(messages: DataFrame, id_: str, text: Column, places: DataFrame, place_id: str, position: str, local: list[str], latin: list[str], code: str | None = None, aliases=ALIASES, not_places=NOT_PLACES, after: str | None = None, most: int = AUTOMATON_BYTES, folded: Column | None = None) -> DataFrame:
    """(id, place_id, matched, how): the place that each message names, no row if none. In this order: an alias of the table that occurs anywhere; the first hashtag that equals a name; the longest name on word boundaries, of three characters at least; the longest Latin name of four letters at least anywhere in the text's letters. Ties go to the place of lowest position and its first name. Of a text with the marker `after` only what follows the last one counts. `folded` is fold_alert() of what counts, where it is at hand. Ids are unique."""
    said = F.substring_index(text, after, -1) if after else text
    empty = F.coalesce(said, F.lit(""))
    barred = F.array(*(fold_alert(F.lit(v)) for v in not_places)) if not_places else F.array().cast("array<string>")
    tags = F.filter(F.transform(hashtags(empty), fold_alert), lambda t: (t != "") & ~F.array_contains(barred, t))
    rows = messages.select(F.col(id_).alias("_id"), empty.alias("_text"), (fold_alert(empty) if folded is None else F.coalesce(folded, F.lit(""))).alias("_folded"), tags.alias("_tags"))

    def search(built, batch):
        ids, out = [], []
        for k, (s, folded, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_text", "_folded", "_tags")), strict=True)):
            hit = built.best(folded, latin_of(s), t)
            if hit:
                ids.append(k)
                out.append(hit)
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(ids, pa.int64())), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], ["_id", "how", "a", "b", "place", "label"])

    kind = dict(rows.dtypes)["_id"]
    patterns = _patterns(places, place_id, position, local, latin, code, aliases)
    got, n = passes(rows, patterns, "key", _Places, search, f"_id {kind}, how int, a long, b long, place long, label string", most)
    if n > 1:
        got = got.groupBy("_id").agg(F.min(F.struct("how", "a", "b", "place", "label")).alias("m")).select("_id", "m.*")
    how = F.element_at(F.array(*map(F.lit, HOW)), F.col("how") + 1)
    return got.select(F.col("_id").alias(id_), F.col("place").alias("place_id"), F.col("label").alias("matched"), how.alias("how"))


HITS = "array<struct<group: string, rank: int, at: int, size: int>>"


def term_index(rows: DataFrame, id_: str, texts: Column, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """(id, index): for each text of a row's list its terms in order of place, each with its group, its rank in the group, its place (from 1) and its length. Terms count anywhere in a text, also within words and within other terms; a null text has none. Groups are short fixed lists."""
    of: dict[str, list] = {}
    for group, terms in groups.items():
        for rank, term in enumerate(terms):
            of.setdefault(term, []).append((group, rank))
    lists = rows.select(F.col(id_).alias("_id"), texts.alias("_texts"))
    kind, token = dict(lists.dtypes)["_id"], uuid.uuid4().hex

    def run(batches):
        if token not in _built:
            _built.clear()
            _built[token] = automaton(of)
        found = _built[token]

        def hits(text):
            got = [(end + 2 - len(w), w) for end, w in found.iter(text)] if text else []
            return [{"group": g, "rank": r, "at": at, "size": len(w)} for at, w in sorted(got) for g, r in of[w]]

        hit = pa.struct([("group", pa.string()), ("rank", pa.int32()), ("at", pa.int32()), ("size", pa.int32())])
        for batch in batches:
            index = [[hits(s) for s in texts or ()] for texts in batch.column("_texts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(index, pa.list_(pa.list_(hit)))], ["_id", "index"])

    return lists.mapInArrow(run, f"_id {kind}, index array<{HITS}>").withColumnRenamed("_id", id_)
