"""Repair of conversation structure by weighted finite-state composition.

A conversation's rows are a linear acceptor. It is composed with an edit transducer (keep, rerole, delete, insert) and with an
acceptor of role initials, `(s?(ua)+)?`. The composition is never built: a state is (row, inserts since the last row, grammar
state), its arcs are made when it is reached, and states are relaxed in topological order. Weights are (cost, edits as a
string), least cost first, then least string. Two inserts in a row are enough, as a third returns to a grammar state that the
first had left, so the composition has no cycle and loses nothing.

Prefixes compare safely: inserts are counted to the row after them, so all strings that reach a row have consumed the same
rows and end in an edit of one; none is a proper prefix of another, and what follows never turns their order.

At scale: a conversation of any length is cut into segments of SEGMENT rows. A segment is summed up as costs and ranks of the
best strings from each grammar state to each (32 small numbers); a conversation's segments are chained over these summaries
alone, and each segment is then solved again, on its own, between the states found. Rows get their places from a range
partition. Texts go once through a shuffle by segment, next to the edits, and come out as pieces of at most PIECE bytes.
The digest and the audit string of a conversation are one value each: the pieces and segments of a conversation longer than a
segment pass one task in order, as a stream (SHA-256 has no other way); rows do not.

Edge cases: null role or text counts as one space, and so does an empty role where initials are compared; rows of one turn go
in order of role, first 64 characters and digest of the text, each before its repetition; rows without a turn come first;
a null conv_id is a conversation; repeated rows are duplicates; texts of any length are streamed; a range of turns beyond 64
bits gives null gaps; an empty table gives no rows. Extra columns are never read.
"""

import hashlib
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.work import Workspace, chunks, n_tasks, numbered

SEGMENT = 1024
PIECE = 4 << 20
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
# costs of the edits; a truncated row that stays costs one more
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
# a row's code: initial of its role, and its fault times four; FIRST marks the row that bears a role and text first
SYSTEM, USER, ASSISTANT, OTHER = range(4)
BLANK, TRUNCATED, DUPLICATE = 4, 8, 12
FIRST = 16
# grammar: states and what each initial leads to; START and A accept
START, S, U, A = range(4)
GRAMMAR = {(START, SYSTEM): S, (START, USER): U, (S, USER): U, (U, ASSISTANT): A, (A, USER): U}
FINAL = (START, A)
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60
TIES = ["role_was", "head", "sum", "copy"]


@cache
def inserts(q: int) -> tuple:
    """Arcs of the composition from grammar state q that consume no row: (next state, role)."""
    return tuple((GRAMMAR[q, r], r) for r in ROLES if (q, r) in GRAMMAR)


@cache
def arcs(q: int, code: int) -> tuple:
    """Arcs from grammar state q that consume a row of this code: (cost, edit, next state)."""
    initial, fault = code & 3, code & 12
    out = [(DELETE_COST, DELETE, q)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        if (q, initial) in GRAMMAR:
            out.append((more, KEEP, GRAMMAR[q, initial]))
        out += [(REROLE_COST + more, REROLE, to) for to, _ in inserts(q)]
    return tuple(out)


def _inserted(live: dict) -> list[dict]:
    """The states reached from live by 0, 1 and 2 inserts."""
    out = [live]
    for _ in range(2):
        new: dict = {}
        for q, (cost, edits) in out[-1].items():
            for to, _role in inserts(q):
                w = (cost + INSERT_COST, edits + INSERT)
                if to not in new or w < new[to]:
                    new[to] = w
        out.append(new)
    return out


def advance(live: dict, codes) -> dict:
    """Best weights by grammar state after the rows of codes, from those before; each string ends in an edit of a row."""
    for code in codes:
        new: dict = {}
        for states in _inserted(live):
            for q, (cost, edits) in states.items():
                for more, edit, to in arcs(q, code):
                    w = (cost + more, edits + edit)
                    if to not in new or w < new[to]:
                        new[to] = w
        live = new
    return live


def finish(live: dict) -> tuple[int, str]:
    """The best weight of an accepted sequence, with inserts at its end."""
    return min(w for states in _inserted(live) for q, w in states.items() if q in FINAL)


def replay(start: int, edits: str, codes):
    """What the edits make of rows: for each row (inserted roles before it, new role or None if it stays or goes, whether it stays); then the inserts at the end and the last state."""
    q, before, out, k = start, [], [], 0
    for e in edits:
        if e == INSERT:
            q, role = inserts(q)[0]
            before.append(role)
            continue
        role = None
        if e == KEEP:
            q = GRAMMAR[q, codes[k] & 3]
        elif e == REROLE:
            q, role = inserts(q)[0]
        out.append((before, role, e != DELETE))
        before, k = [], k + 1
    return out, before, q


def summary(codes, last: bool) -> tuple[list[int], list[int]]:
    """(costs, ranks), each 4 x 4: from each state to each. Ranks order the strings that start in one state. A last segment has one end, column 0."""
    costs, ranks = [NEVER] * 16, [0] * 16
    for a in (START, S, U, A):
        ends = advance({a: (0, "")}, codes)
        if last:
            costs[4 * a] = finish(ends)[0]
            continue
        for rank, b in enumerate(sorted(ends, key=lambda q: ends[q][1])):
            costs[4 * a + b], ranks[4 * a + b] = ends[b][0], rank
    return costs, ranks


def chain(costs: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """State before each segment, from the segments' summaries in order: best total cost, then best string."""
    n = len(costs)
    total, order = [0, NEVER, NEVER, NEVER], [0, 0, 0, 0]
    back = np.zeros((n, 4), np.int8)
    for k in range(n):
        c, r = costs[k].tolist(), ranks[k].tolist()
        # of equal costs that from the state whose string is least: strings to one end from two states differ before this segment
        pick = [min(range(4), key=lambda a, b=b: (total[a] + c[4 * a + b], order[a])) for b in range(4)]
        back[k] = pick
        fresh = [min(NEVER, total[a] + c[4 * a + b]) for b, a in enumerate(pick)]
        rank = sorted(range(4), key=lambda b: (order[pick[b]], r[4 * pick[b] + b]))
        total, order = fresh, [rank.index(b) for b in range(4)]
    out, q = np.zeros(n, np.int8), 0
    for k in range(n - 1, -1, -1):
        q = out[k] = back[k][q]
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, TIES) of rows after the damage that the check sum of conversation and turn calls for."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = rows.select("conv_id", "turn", or_space("role").alias("role_was"), or_space("text").alias("was"))
    x = x.withColumn("d", F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20).where("d <> 0")
    x = x.withColumn("copy", F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("d") == 1, F.lit("")).when(F.col("d") == 2, F.translate("was", ".!?", "")).otherwise(F.col("was"))
    role = F.when(F.col("d") == 4, F.lit("user")).otherwise(F.col("role_was"))
    order = {"head": F.substring("was", 1, 64), "sum": F.unhex(F.sha2("was", 256))}
    return x.withColumns({"role": role, "text": text, **order}).drop("d", "was")


def _codes(role: Column, text: Column) -> Column:
    body = F.btrim(text, F.lit(BLANKS))
    first = F.substring(role, 1, 1)
    initial = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    return initial + F.when(body == "", BLANK).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)


def _legal(pair: tuple[int, int]) -> bool:
    return pair in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def _decoded(seg: int, places, codes) -> tuple[int | None, list[int]]:
    """From a segment's sorted (place, code): the initial of the row before the segment, and its rows' codes with duplicates told."""
    before, out, first = None, [], set()
    rows = []
    for i, c in zip(places, codes, strict=True):
        if i < seg * SEGMENT:
            before = c & 3
        elif c == FIRST:
            first.add(i)
        else:
            rows.append((i, c))
    for i, c in rows:
        # a blank row is blank; any other that is not the first of its kind is a duplicate, whatever its end
        out.append(c if c & 12 == BLANK or i in first else (c & 3) | DUPLICATE)
    return before, out


def _summaries(batches):
    for batch in batches:
        for grp, n, seg, i, code in zip(*(batch.column(c).to_pylist() for c in ("grp", "n", "seg", "i", "code")), strict=True):
            costs, ranks = summary(_decoded(seg, i, code)[1], (seg + 1) * SEGMENT >= n)
            yield pa.RecordBatch.from_pylist([{"grp": grp, "seg": seg, "costs": costs, "ranks": ranks}], pa.schema({"grp": pa.string(), "seg": pa.int64(), "costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int64())}))


def _streams(batches, columns):
    """Rows of Arrow batches as tuples."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _chains(batches):
    held: list = []

    def out():
        states = chain(np.array([h[2] for h in held]), np.array([h[3] for h in held]))
        return pa.RecordBatch.from_pydict({"grp": [h[0] for h in held], "seg": pa.array([h[1] for h in held], pa.int64()), "begin": pa.array(states.tolist(), pa.int32()), "end": pa.array([*states[1:].tolist(), -1], pa.int32())})

    for row in _streams(batches, ("grp", "seg", "costs", "ranks")):
        if held and held[0][0] != row[0]:
            yield out()
            held = []
        held.append((row[0], row[1], np.array(row[2]), np.array(row[3], np.int8)))
    if held:
        yield out()


STATS = ("blank", "duplicate", "truncated", "illegal", "cost")
SOLVED = "grp string, n long, seg long, piece int, edits string, " + ", ".join(f"{s} long" for s in STATS) + ", digest string, body binary"
_SOLVED = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("seg", pa.int64()), ("piece", pa.int32()), ("edits", pa.string()), *((s, pa.int64()) for s in STATS), ("digest", pa.string()), ("body", pa.binary())])


class _Segment:
    """Edits of a segment, and its repaired text as the rows come; where only digests are wanted, that of a conversation of one segment."""

    def __init__(self, texts, grp, n, seg, places, codes, begin, end):
        self.key, self.pieces = (grp, n, seg), 0
        before, rows = _decoded(seg, places, codes)
        live = advance({begin: (0, "")}, rows)
        cost, self.edits = finish(live) if end < 0 else live[end]
        faults = [c & 12 for c in rows]
        initials = [*([] if before is None else [before]), *(c & 3 for c in rows)]
        illegal = sum(not _legal(p) for p in zip(initials, initials[1:], strict=False))
        self.stats = dict(zip(STATS, (faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, cost), strict=True))
        self.plan, self.tail, _ = replay(begin, self.edits, rows)
        self.at, self.body = 0, bytearray()
        self.running = None if texts or n > SEGMENT else hashlib.sha256()
        self.begun = False

    def _put(self, role: str, text: str) -> None:
        item = f"\n{role}:{text}".encode()
        if self.running is None:
            self.body += item
        else:
            self.running.update(item if self.begun else item[1:])
            self.begun = True

    def row(self, role: str, text: str) -> None:
        before, new, stays = self.plan[self.at]
        for r in before:
            self._put(ROLES[r], "")
        if stays:
            self._put(role if new is None else ROLES[new], text)
        self.at += 1

    def record(self, last: bool) -> dict:
        if last:
            for r in self.tail:
                self._put(ROLES[r], "")
        first = self.pieces == 0
        body, self.body = bytes(self.body), bytearray()
        self.pieces += 1
        stats = self.stats if first else dict.fromkeys(STATS, 0)
        return {**dict(zip(("grp", "n", "seg"), self.key, strict=True)), "piece": self.pieces - 1, "edits": self.edits if first else "", **stats, "digest": self.running.hexdigest() if self.running else None, "body": body}


def _solve(texts: bool, batches):
    """Sorted rows of segments, each led by its places and codes: edits, counts and pieces of repaired text. Each piece's items begin with a line feed."""
    now, out, size = None, [], 0
    names = ("grp", "n", "seg", "i", "role", "text", "places", "codes", "begin", "end")
    for table in chunks(batches, PIECE):
        for grp, n, seg, i, role, text, places, codes, begin, end in _streams(table.to_batches(), names):
            if i < 0:
                if now:
                    out.append(now.record(True))
                now = _Segment(texts, grp, n, seg, places, codes, begin, end)
            else:
                now.row(role, text)
                if len(now.body) >= PIECE:
                    out.append(now.record(False))
            if out:
                size += len(out[-1]["body"]) + 1000
            if size >= PIECE:
                yield pa.RecordBatch.from_pylist(out, _SOLVED)
                out, size = [], 0
    if now:
        out.append(now.record(True))
    if out:
        yield pa.RecordBatch.from_pylist(out, _SOLVED)


def _digests(batches):
    """Pieces sorted by conversation and place: each conversation's digest, without the first line feed."""
    now, running = None, None
    for grp, body in _streams(batches, ("grp", "body")):
        if grp != now:
            if running:
                yield pa.RecordBatch.from_pydict({"grp": [now], "repaired_sha256": [running.hexdigest()]})
            now, running, empty = grp, hashlib.sha256(), True
        running.update(body[1:] if empty else body)
        empty = empty and not body
    if running:
        yield pa.RecordBatch.from_pydict({"grp": [now], "repaired_sha256": [running.hexdigest()]})


def repair(spark: SparkSession, rows: DataFrame, ties: list[str], ws: Workspace | None = None, texts: bool = True) -> tuple[DataFrame, DataFrame]:
    """From rows (conv_id, turn, role, text, and the columns ties that order rows of one turn): conversations (grp, counts, cost, audit, gaps), and pieces of repaired text (grp, seg, piece, digest, body), whose bodies in order, without the first line feed, are the conversation. Without texts a conversation of one segment has its digest in place of a body."""
    ws = ws or Workspace(spark, "conversations")
    named = rows.withColumns({"grp": group_key(), "code": _codes(F.col("role"), F.col("text")), "same": F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))})
    placed = numbered(ws, named, "grp", ["turn", *ties], "rows", write_first=False).withColumn("seg", (F.col("i") / SEGMENT).cast("long"))
    first = placed.where(F.col("code").bitwiseAND(12) != BLANK).groupBy("grp", "n", "same").agg(F.min("i").alias("i"))
    marks = first.select("grp", "n", (F.col("i") / SEGMENT).cast("long").alias("seg"), "i", F.lit(FIRST).alias("code"))
    own = placed.select("grp", "n", "seg", "i", "code")
    # the last row of a segment also shows itself to the next
    over = own.where((F.col("i") + 1) % SEGMENT == 0).where(F.col("i") + 1 < F.col("n")).withColumn("seg", F.col("seg") + 1)
    packed = own.unionByName(marks).unionByName(over).groupBy("grp", "n", "seg").agg(F.sort_array(F.collect_list(F.struct("i", "code"))).alias("x"))
    segments = ws.stage(packed.select("grp", "n", "seg", F.col("x.i").alias("i"), F.col("x.code").alias("code")), "segments")
    long = segments.where(F.col("n") > SEGMENT).mapInArrow(_summaries, "grp string, seg long, costs array<long>, ranks array<long>")
    states = long.repartition(n_tasks(spark), "grp").sortWithinPartitions("grp", "seg").mapInArrow(_chains, "grp string, seg long, begin int, end int")
    segments = segments.join(ws.stage(states, "states"), ["grp", "seg"], "left")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("places", "array<long>"), ("codes", "array<int>"), ("begin", "int"), ("end", "int"))]
    heads = segments.select("grp", "n", "seg", F.lit(-1).cast("long").alias("i"), F.lit("").alias("role"), F.lit("").alias("text"), F.col("i").alias("places"), F.col("code").alias("codes"), F.coalesce("begin", F.lit(START)).alias("begin"), F.coalesce("end", F.lit(-1)).alias("end"))
    lines = heads.unionByName(placed.select("grp", "n", "seg", "i", "role", "text", *none))
    solved = lines.repartition(n_tasks(spark), "grp", "seg").sortWithinPartitions("grp", "seg", "i").mapInArrow(partial(_solve, texts), SOLVED)
    solved = ws.stage(solved, "solved")
    sums = solved.groupBy("grp").agg(*(F.sum(s).alias(s) for s in STATS), F.sort_array(F.collect_list(F.when(F.col("edits") != "", F.struct("seg", "edits")))).alias("e"))
    wide = lambda x: x.cast("decimal(38,0)")
    gaps = F.coalesce(wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("turn"), F.lit(0))
    turns = placed.groupBy("grp", "turn").agg(F.count("*")).groupBy("grp").agg(gaps.try_cast("long").alias("gaps"))
    return sums.select("grp", *STATS, F.array_join("e.edits", "").alias("audit")).join(turns, "grp"), solved.select("grp", "seg", "piece", "digest", "body")


def group_key() -> Column:
    return F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit(""))


def digests(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """(grp, repaired_sha256). Conversations without a digest yet pass one task each, piece by piece."""
    done = pieces.where("digest IS NOT NULL").select("grp", F.col("digest").alias("repaired_sha256"))
    rest = pieces.where("digest IS NULL").select("grp", "seg", "piece", "body").repartition(n_tasks(spark), "grp").sortWithinPartitions("grp", "seg", "piece")
    return done.unionByName(rest.mapInArrow(_digests, "grp string, repaired_sha256 string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: faults and cheapest repair of every conversation after damage."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    ws = Workspace(spark, "op12")
    found, pieces = repair(spark, damaged(rows), TIES, ws, texts=False)
    all_ = rows.select("conv_id").distinct().withColumn("grp", group_key())
    out = all_.join(found, "grp", "left").join(digests(spark, pieces), "grp", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.when(F.col("audit").isNull(), F.lit(0)).otherwise(F.col("gaps")).cast("long").alias("gaps")
    return out.select("conv_id", gaps, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# the same shortest paths row by row: best weight of each grammar state (0 start, 1 s, 2 u, 3 a), with the repaired text beside it
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda p: ascii(substr(k, p::INT, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"
ORACLE = rf"""
WITH RECURSIVE raw AS (SELECT coalesce(':' || conv_id, '') AS g, turn, coalesce(role, ' ') AS was_role, coalesce(text, ' ') AS was, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
 hit AS (SELECT *, {_CRC} % 20 AS d FROM raw),
 rows_ AS (SELECT g, turn, was_role, was, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy, CASE WHEN d = 4 THEN 'user' ELSE was_role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(was, '.!?', '') ELSE was END AS text FROM hit WHERE d <> 0),
 placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, was_role, left(was, 64), sha256(was), copy) AS i, trim(text, e' \t\n\x0b\x0c\r') AS body, left(role, 1) AS init FROM rows_),
 p AS MATERIALIZED (SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(init) OVER (PARTITION BY g ORDER BY i) AS before FROM placed),
 ins(q, q2, k, t) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, e'\nuser:'), (1, 2, 1, e'\nuser:'), (3, 2, 1, e'\nuser:'), (2, 3, 1, e'\nassistant:'),
  (0, 3, 2, e'\nuser:\nassistant:'), (1, 3, 2, e'\nuser:\nassistant:'), (3, 3, 2, e'\nuser:\nassistant:'), (2, 2, 2, e'\nassistant:\nuser:')),
 eats(q, edit, init, q2, cost, role) AS (VALUES (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL), (3, 'K', 'u', 2, 0, NULL),
  (0, 'R', NULL, 2, 2, 'user'), (1, 'R', NULL, 2, 2, 'user'), (3, 'R', NULL, 2, 2, 'user'), (2, 'R', NULL, 3, 2, 'assistant'), (0, 'D', NULL, 0, 3, NULL), (1, 'D', NULL, 1, 3, NULL), (2, 'D', NULL, 2, 3, NULL), (3, 'D', NULL, 3, 3, NULL)),
 w(g, i, q, best) AS (SELECT DISTINCT g, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'edits': '', 'body': ''}} FROM p
  UNION ALL SELECT w.g, p.i, eats.q2, min({{'cost': w.best.cost + 2 * ins.k + eats.cost + CASE WHEN fault = 't' AND edit <> 'D' THEN 1 ELSE 0 END, 'edits': w.best.edits || repeat('I', ins.k) || edit,
   'body': w.best.body || ins.t || CASE WHEN edit = 'D' THEN '' ELSE chr(10) || coalesce(eats.role, p.role) || ':' || p.text END}})
  FROM w JOIN p ON p.g = w.g AND p.i = w.i + 1 JOIN ins ON ins.q = w.q JOIN eats ON eats.q = ins.q2 AND (eats.init IS NULL OR eats.init = p.init)
  WHERE edit = 'D' OR fault NOT IN ('b', 'd') GROUP BY w.g, p.i, eats.q2),
 done AS (SELECT w.g, min({{'cost': w.best.cost + 2 * ins.k, 'edits': w.best.edits || repeat('I', ins.k), 'body': w.best.body || ins.t}}) AS best
  FROM w JOIN (SELECT g, max(i) AS i FROM p GROUP BY g) AS m ON m.g = w.g AND m.i = w.i JOIN ins ON ins.q = w.q AND ins.q2 IN (0, 3) GROUP BY w.g),
 counts AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before || init NOT IN ('su', 'ua', 'au')) AS illegal FROM p GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
 coalesce(best.edits, '') AS audit, sha256(coalesce(substr(best.body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(':' || conv_id, '') AS g FROM conversations) LEFT JOIN counts USING (g) LEFT JOIN done USING (g)
"""
