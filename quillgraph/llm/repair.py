"""Conversation structure repair by A* on the lattice of edits.

A node is a number of rows read and a state of the pattern that roles must
follow: an optional system turn, then user and assistant in turn.  Edges keep a
row, rerole it, delete it, or insert a turn.  Ahead of a node lie at least the
deletions that blank and repeated rows demand and, for each truncated row, the
lesser of deleting and keeping it: their suffix sums are the heuristic.  It
never falls by more than an edge costs, so with the key (cost and heuristic,
audit) the first visit of a node has its least cost and, among those, the least
audit in ASCII order.

Conversations lie sorted over ranges of rows.  One that ends within its range
and has few rows is searched from beginning to end.  Of others, a segment of
rows gives a table: for each state that it is entered and left in, the least
cost, and how the audits to different ends compare.  Given the rows, letters
of an audit determine the states, and audits that end by reading the same row
never begin one another, so tables compose without the audits themselves:
segments to ranges, ranges to the conversation, and back down each segment
learns its two states and is searched between them.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import in_batches, read_table, released_group, written

#: Rows and characters of a segment.
SEGMENT_ROWS, SEGMENT_CHARS = 256, 1 << 20

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES, ENDS = range(4), (0, 3)
#: The turn that a state lets be inserted, the state after it, and what kept roles lead to.
EXPECTED = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What must follow the last row in each state.
TAIL = ("", "II", "I", "")
LEGAL = ("su", "ua", "au")

_BLANK = re.compile(r"[^\x20\x09-\x0D]")
_SPACE = " \t\n\x0b\x0c\r"
SOUND, MUST_GO, CUT_OFF = range(3)

Path = tuple[int, str]
#: For each entry and exit: least cost and the place of its audit among those of the entry; None where no path leads.
Table = list[list[tuple[int, int] | None]]


class Rows(NamedTuple):
    """Rows of a segment: roles, texts and their faults, as far as edits depend on them."""

    roles: list[str]
    texts: list[str]
    faults: list[int]


def search(rows: Rows, entry: int, whole: bool) -> dict[int, Path]:
    """Least cost and audit from the state before the first row to each state after the last one; of a whole conversation to an allowed end alone."""
    n = len(rows.roles)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (0 if rows.faults[i] == SOUND else min(DELETE, TRUNCATED) if rows.faults[i] == CUT_OFF else DELETE)
    heap, seen, found = [(ahead[0], "", 0, entry)], set(), {}
    while heap:
        f, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        cost = f - ahead[i]
        if i == n:
            if not whole or state in ENDS:
                found[state] = (cost, audit)
                if whole or len(found) == len(STATES):
                    return found
        if i < n or whole:
            heapq.heappush(heap, (f + INSERT, audit + "I", i, AFTER[state]))
        if i == n:
            continue
        fault, rest = rows.faults[i], cost + ahead[i + 1]
        heapq.heappush(heap, (rest + DELETE, audit + "D", i + 1, state))
        if fault != MUST_GO:
            rest += TRUNCATED * (fault == CUT_OFF)
            heapq.heappush(heap, (rest + REROLE, audit + "R", i + 1, AFTER[state]))
            if (next_ := KEPT[state].get(rows.roles[i][:1])) is not None:
                heapq.heappush(heap, (rest, audit + "K", i + 1, next_))
    return found


def table(rows: Rows) -> Table:
    out: Table = []
    for entry in STATES:
        found = search(rows, entry, False)
        place = {end: k for k, end in enumerate(sorted(found, key=lambda e: found[e][1]))}
        out.append([(found[e][0], place[e]) if e in found else None for e in STATES])
    return out


IDENTITY: Table = [[(0, 0) if a == b else None for b in STATES] for a in STATES]


def compose(first: Table, second: Table) -> tuple[Table, list[list[int]]]:
    """The table of two segments in a row, and the state between them for each entry and exit."""
    out: Table = []
    through = []
    for row in first:
        best: list[tuple[int, int, int] | None] = []
        for end in STATES:
            ways = [(row[m][0] + second[m][end][0], row[m][1], m) for m in STATES if row[m] is not None and second[m][end] is not None]
            best.append(min(ways, default=None))
        order = sorted((b[1], second[b[2]][end][1], end) for end, b in enumerate(best) if b is not None)
        place = {end: k for k, (_, _, end) in enumerate(order)}
        out.append([(b[0], place[end]) if b is not None else None for end, b in enumerate(best)])
        through.append([b[2] if b is not None else -1 for b in best])
    return out, through


def trace(tables: list[Table], entry: int, end: int) -> list[tuple[int, int]]:
    """Entry and exit of each segment on the best path between two states."""
    so_far, between = IDENTITY, []
    for t in tables:
        so_far, through = compose(so_far, t)
        between.append(through[entry])
    states = [end]
    for through in reversed(between):
        states.append(through[states[-1]])
    states.reverse()
    return list(zip(states, states[1:]))


def edited(rows: Rows, audit: str, entry: int) -> list[str]:
    """``role:text`` of each turn that the edits leave."""
    out, state, i = [], entry, 0
    for letter in audit:
        if letter == "I":
            out.append(f"{EXPECTED[state]}:")
            state = AFTER[state]
            continue
        if letter == "K":
            out.append(f"{rows.roles[i]}:{rows.texts[i]}")
            state = KEPT[state][rows.roles[i][:1]]
        elif letter == "R":
            out.append(f"{EXPECTED[state]}:{rows.texts[i]}")
            state = AFTER[state]
        i += 1
    return out


class Facts:
    """Counts over rows in order that can be put together from those of parts."""

    FIELDS = ("rows", "turns", "least", "most", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role")

    def __init__(self, *values) -> None:
        for name, value in zip(self.FIELDS, values or (0, 0, None, None, 0, 0, 0, 0, None, None)):
            setattr(self, name, value)

    def values(self) -> list:
        return [getattr(self, name) for name in self.FIELDS]

    def add(self, other: Facts) -> None:
        if not other.rows:
            return
        if self.rows and self.last_role + other.first_role not in LEGAL:
            self.illegal += 1
        if self.most is not None and self.most == other.least:
            self.turns -= 1
        for name in ("rows", "turns", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.least = other.least if self.least is None else self.least
        self.most = self.most if other.most is None else other.most
        self.first_role, self.last_role = (other.first_role if self.first_role is None else self.first_role), other.last_role

    def row(self, turn: int | None, role: str, text: str, repeated: bool) -> int:
        """Add a row; returns what is wrong with it."""
        solid = _BLANK.search(text)
        blank, cut_off = solid is None, solid is not None and text.rstrip(_SPACE)[-1] not in ".!?"
        known = turn is not None
        self.add(Facts(1, int(known), turn, turn, int(blank), int(not blank and repeated), int(not blank and not repeated and cut_off), 0, role[:1], role[:1]))
        return MUST_GO if blank or repeated else CUT_OFF if cut_off else SOUND

    @property
    def gaps(self) -> int:
        return 0 if self.most is None else self.most - self.least + 1 - self.turns


_FACTS = "rows long, turns long, least long, most long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string"
#: A row is a whole conversation (seq -1), a range's share of one (seq -2) or a segment.
_FOUND = f"part int, seq int, {_FACTS}, cost long, audit string, turns_left long, repaired string, costs array<int>, places array<int>, roles array<string>, texts array<string>, faults array<int>"
WHOLE, SHARE = -1, -2


def _flat(t: Table) -> tuple[list[int | None], list[int | None]]:
    cells = [c for row in t for c in row]
    return [c and c[0] for c in cells], [c and c[1] for c in cells]


def _table(costs: list[int | None], places: list[int | None]) -> Table:
    cells = [None if c is None else (c, p) for c, p in zip(costs, places)]
    return [cells[k : k + len(STATES)] for k in range(0, len(cells), len(STATES))]


def _ranges(batches: Iterator[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows of conv_id, turn, role, text, copies, later as whole conversations, shares and segments."""
    part = TaskContext.get().partitionId()
    ready: list[tuple] = []
    conv, begun, first = None, False, True
    facts, share, current, chars = Facts(), IDENTITY, Rows([], [], []), 0
    seq, before = 0, None

    def close() -> None:
        """Give out a segment."""
        nonlocal share, current, chars, seq
        t = table(current)
        share, _ = compose(share, t)
        ready.append((conv, part, seq, *Facts().values(), None, None, None, None, *_flat(t), *current))
        current, chars, seq = Rows([], [], []), 0, seq + 1

    def end(last: bool) -> None:
        nonlocal share, current, chars, seq, facts, first
        if seq == 0 and not first and not last:
            (cost, audit), *_ = search(current, 0, True).values()
            left = edited(current, audit, 0)
            ready.append((conv, part, WHOLE, *facts.values(), cost, audit, len(left), "\n".join(left), None, None, None, None, None))
        else:
            close()
            ready.append((conv, part, SHARE, *facts.values(), None, None, None, None, *_flat(share), None, None, None))
        facts, share, current, chars, seq, first = Facts(), IDENTITY, Rows([], [], []), 0, 0, False

    def give() -> pa.RecordBatch:
        columns = list(zip(*ready))
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)
        ready.clear()
        return batch

    for batch in batches:
        for id_, turn, role, text, copies, later in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or id_ != conv:
                if begun:
                    end(False)
                conv, begun, before = id_, True, None
            for k in range(copies):
                repeated = later or k > 0 or before == (turn, role, text)
                fault = facts.row(turn, role, text, repeated)
                if len(current.roles) == SEGMENT_ROWS or chars > SEGMENT_CHARS:
                    close()
                current.roles.append(role)
                # a row that must go is kept without its text
                current.texts.append("" if fault == MUST_GO else text)
                current.faults.append(fault)
                chars += len(current.texts[-1])
                if len(ready) >= 256:
                    yield give()
            if copies:
                before = (turn, role, text)
        if ready:
            yield give()
    if begun:
        end(True)
        yield give()


def _paths(shares: pa.Table) -> pa.Table:
    """Entry and exit of each range of a conversation, and the conversation's facts."""
    rows = sorted(shares.to_pylist(), key=lambda r: r["part"])
    facts = Facts()
    for r in rows:
        facts.add(Facts(*(r[f] for f in Facts.FIELDS)))
    tables = [_table(r["costs"], r["places"]) for r in rows]
    total = IDENTITY
    for t in tables:
        total, _ = compose(total, t)
    ways = [(total[0][e][0] + INSERT * len(TAIL[e]), total[0][e][1], e) for e in STATES if total[0][e] is not None]
    cost, _, last = min(ways)
    steps = trace(tables, 0, last)
    n = len(rows)
    columns = {
        "conv_id": shares.column("conv_id").take(pa.array([0] * n)),
        "part": pa.array([r["part"] for r in rows], pa.int32()),
        "entry": pa.array([a for a, _ in steps], pa.int32()),
        "end": pa.array([b for _, b in steps], pa.int32()),
        "tail": pa.array([""] * (n - 1) + [TAIL[last]]),
    }
    for name, value in (("gaps", facts.gaps), ("blank", facts.blank), ("duplicate", facts.duplicate), ("truncated", facts.truncated), ("illegal", facts.illegal), ("cost", cost)):
        columns[name] = pa.array([value] * n, pa.int64())
    return pa.table(columns)


def _segment_paths(segments: pa.Table) -> pa.Table:
    """Entry and exit of each segment of one range of a conversation."""
    rows = sorted(segments.to_pylist(), key=lambda r: r["seq"])
    steps = trace([_table(r["costs"], r["places"]) for r in rows], rows[0]["entry"], rows[0]["end"])
    first = pa.array([0] * len(rows))
    out = {"conv_id": segments.column("conv_id").take(first), "part": pa.array([r["part"] for r in rows], pa.int32()), "seq": pa.array([r["seq"] for r in rows], pa.int32())}
    out |= {"seg_entry": pa.array([a for a, _ in steps], pa.int32()), "seg_end": pa.array([b for _, b in steps], pa.int32()), "last": pa.array([k == len(rows) - 1 for k in range(len(rows))])}
    return pa.table(out)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their entry and exit as edits and what they leave."""
    for batch in batches:
        rows = batch.to_pylist()
        audits, counts, texts = [], [], []
        for r in rows:
            segment = Rows(r["roles"], r["texts"], r["faults"])
            audit = search(segment, r["seg_entry"], False)[r["seg_end"]][1] + (r["tail"] if r["last"] else "")
            left = edited(segment, audit, r["seg_entry"])
            audits.append(audit)
            counts.append(len(left))
            texts.append("\n".join(left))
        kept = [batch.column(name) for name in ("conv_id", "part", "seq", *COUNTS)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(audits, pa.string()), pa.array(counts, pa.int64()), pa.array(texts, pa.string())], ["conv_id", "part", "seq", *COUNTS, "audit", "turns_left", "repaired"])


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(turns: DataFrame) -> DataFrame:
    """Cheapest edits that give each conversation's roles the form (s?(ua)+)?: ``conv_id, part, seq, gaps, blank, duplicate, truncated, illegal, cost, audit, turns_left, repaired``.

    ``turns`` has conv_id, turn, role, text and may have copies (how often a
    row comes; 0: it only says that the conversation exists).  A conversation
    is one row (seq -1), or several whose audits and repaired turns (joined by
    line breaks; ``turns_left`` of them) follow each other by (part, seq); the
    counts are those of the whole conversation each time.

    Rows go by turn (nulls first), then role and text.  Null roles and texts
    count as one space.  Rows of a null conv_id form one conversation.  A role
    without letters fits nowhere, neither kept nor in a legal pair.  Repeated
    rows are duplicates after the first; of ties in cost the edits whose
    initials come first in ASCII order count.  Further columns are ignored; an
    empty table gives no rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies").cast("int") if "copies" in turns.columns else F.lit(1)
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), copies.alias("copies"))
    gone = F.col("copies") <= 0
    t = t.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), *(F.when(gone, "").otherwise(F.col(c)).alias(c) for c in ("role", "text")), "copies")
    t = t.withColumn("same", F.sha2(F.concat("role", F.lit("\n"), "text").cast("binary"), 256))
    # which turn has a role and text first; partial aggregates come before the shuffle
    firsts = t.where("copies > 0").groupBy(F.col("conv_id").alias("conv"), F.col("same").alias("same_")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.sum("copies").alias("times"))
    firsts = firsts.where("times > 1").select("conv", "same_", F.col("first.turn").alias("first"))
    j = t.join(firsts, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("same") == F.col("same_")), "left")
    later = F.col("same_").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = j.select(*order, "copies", later.alias("later")).repartitionByRange(*order).sortWithinPartitions(*order)
    id_type = turns.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"conv_id {id_type}, {_FOUND}")
    arrow = _arrow_schema(schema)
    found = written(ranged.transform(in_batches(lambda batches: _ranges(batches, arrow), schema)), "repair")

    whole = found.where(F.col("seq") == WHOLE).withColumn("gaps", F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0).cast("long")))
    whole = whole.select("conv_id", "part", "seq", *COUNTS, "audit", "turns_left", "repaired")
    shares = found.where(F.col("seq") == SHARE).select("conv_id", "part", *Facts.FIELDS, "costs", "places")
    paths = shares.groupBy("conv_id").applyInArrow(released_group(_paths), f"conv_id {id_type}, part int, entry int, end int, tail string, " + ", ".join(f"{c} long" for c in COUNTS))
    segments = found.where(F.col("seq") >= 0)
    p = paths.withColumnRenamed("conv_id", "conv").withColumnRenamed("part", "part_")
    same_range = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("part_"))
    light = segments.select("conv_id", "part", "seq", "costs", "places").join(p.select("conv", "part_", "entry", "end"), same_range).drop("conv", "part_")
    steps = light.groupBy("conv_id", "part").applyInArrow(released_group(_segment_paths), f"conv_id {id_type}, part int, seq int, seg_entry int, seg_end int, last boolean")
    s = steps.select(F.col("conv_id").alias("conv2"), F.col("part").alias("part2"), F.col("seq").alias("seq2"), "seg_entry", "seg_end", "last")
    joined = segments.select("conv_id", "part", "seq", "roles", "texts", "faults").join(s, F.col("conv_id").eqNullSafe(F.col("conv2")) & (F.col("part") == F.col("part2")) & (F.col("seq") == F.col("seq2")))
    joined = joined.join(p.select("conv", "part_", "tail", *COUNTS), same_range).select("conv_id", "part", "seq", "roles", "texts", "faults", "seg_entry", "seg_end", "last", "tail", *COUNTS)
    return whole.unionByName(joined.transform(in_batches(_pieces, whole.schema)))


def _arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation: counts, the audit and the digest of the repaired turns.

    Pieces of a conversation are read in order and only its audit and the state
    of its digest are held, so a conversation of any size fits.
    """
    columns = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    one = pieces.where(F.col("seq") == WHOLE).select("conv_id", *COUNTS, "audit", F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, counts, audit, digest, lines, begun = None, None, [], hashlib.sha256(), 0, False

        def row() -> pa.RecordBatch:
            values = [[conv], *([c] for c in counts), ["".join(audit)], [digest.hexdigest()]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

        for batch in batches:
            for r in batch.to_pylist():
                if not begun or r["conv_id"] != conv:
                    if begun:
                        yield row()
                    conv, counts, audit, digest, lines, begun = r["conv_id"], [r[c] for c in COUNTS], [], hashlib.sha256(), 0, True
                audit.append(r["audit"])
                if r["turns_left"]:
                    digest.update(("\n" if lines else "").encode() + r["repaired"].encode())
                    lines += r["turns_left"]
        if begun:
            yield row()

    arrow = _arrow_schema(one.schema)
    many = pieces.where(F.col("seq") != WHOLE).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return one.unionByName(many.transform(in_batches(join, one.schema))).select(*columns)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with one fault in five by a hash of conversation and turn: dropped (copies 0), emptied, without sentence ends, twice, or said by the user."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    role = F.when(fate == 4, "user").otherwise(some("role"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return digests(repair(damaged(read_table(spark, sf_dir, "conversations"))))


def _more(key: str, cost: str, letter: str) -> str:
    """SQL: a path (nine digits of cost, then its audit) with one more edit."""
    return f"(lpad(CAST(CAST(left({key}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({key}, 10) || '{letter}')"


def _read(key: str, initials: str) -> str:
    """SQL: a path on which the next row is kept, if its role begins with one of the initials, or reroled to the role that follows."""
    reroled = _more(key, f"{REROLE} + charge", "R")
    return f"CASE WHEN must_go THEN NULL WHEN initial IN ({initials}) THEN {_more(key, 'charge', 'K')} ELSE {reroled} END"


_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
OP13_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, x: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc),
fates AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({_KEY}, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) % 20 AS fate
  FROM conversations, crc_table),
harmed AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM fates WHERE fate <> 0),
placed AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM harmed),
counted AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS is_cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS initial_before FROM placed),
faults AS (
  SELECT conv_id, turn, role, text, initial, pos, is_blank, NOT is_blank AND seen AS is_repeated, NOT is_blank AND NOT seen AND is_cut AS is_truncated, is_blank OR seen AS must_go,
    CASE WHEN NOT is_blank AND NOT seen AND is_cut THEN {TRUNCATED} ELSE 0 END AS charge, pos > 1 AND initial_before || initial NOT IN ('su', 'ua', 'au') AS is_illegal FROM counted),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_repeated) AS duplicate,
    count(*) FILTER (is_truncated) AS truncated, count(*) FILTER (is_illegal) AS illegal, max(pos) AS n FROM faults GROUP BY conv_id),
paths(conv_id, pos, d0, d1, d2, d3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, {_more("d0", str(DELETE), "D")}, least({_more("d1", str(DELETE), "D")}, CASE WHEN NOT must_go AND initial = 's' THEN {_more("d0", "charge", "K")} END),
    least({_more("i2", str(DELETE), "D")}, {_read("d0", "'u'")}, {_read("d1", "'u'")}, {_read("i3", "'u'")}), least({_more("i3", str(DELETE), "D")}, {_read("i2", "'a'")})
  FROM (
    SELECT *, least(d3, {_more("i2", str(INSERT), "I")}) AS i3 FROM (
      SELECT p.*, f.* EXCLUDE (conv_id, pos), f.pos AS next_pos, least(d2, {_more("d0", str(INSERT), "I")}, {_more("d1", str(INSERT), "I")}, {_more("d3", str(INSERT), "I")}) AS i2
      FROM paths p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1)) AS step(conv_id, pos_before, d0, d1, d2, d3, turn, role, text, initial, is_blank, is_repeated, is_truncated, must_go, charge, is_illegal, pos, i2, i3)),
best AS (
  SELECT p.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    least(d0, d3, {_more("d2", str(INSERT), "I")}, {_more("d1", str(2 * INSERT), "II")}) AS path
  FROM paths p LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.pos = coalesce(f.n, 0)),
letters AS (SELECT conv_id, unnest(string_split(substr(path, 10), '')) AS letter, generate_subscripts(string_split(substr(path, 10), ''), 1) AS k FROM best WHERE length(path) > 9),
edits AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS at_row, count(*) FILTER (letter <> 'D') OVER w AS at_turn FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
joined AS (
  SELECT e.*, f.role, f.text, max(CASE WHEN letter = 'K' AND at_turn = 1 AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = e.at_row AND e.letter <> 'I' WHERE e.letter <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (at_turn - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY at_turn) AS repaired
  FROM joined GROUP BY conv_id)
SELECT b.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(left(path, 9) AS BIGINT) AS cost, substr(path, 10) AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM best b LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
"""
