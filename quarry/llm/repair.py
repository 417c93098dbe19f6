"""Repair of the turn structure of conversations by weighted CYK parsing over intervals of rows.

A conversation should read `(s?(ua)+)?` in the initials of its roles. Rows may be kept, given another role,
or deleted, and empty user and assistant rows may be inserted anywhere; each edit has a cost. The repair
grammar is in Chomsky normal form. A nonterminal [p, q] derives the rows and insertions that lead from
place p of the pattern to place q (start, after system, after user, after assistant):

    [p, q] -> [p, r] [r, q]       two neighbouring intervals
    [p, q] -> a row               kept, given a role, or (p = q) deleted
    [p, q] -> nothing             insertions; cells are closed under them before they are combined

The chart holds per interval and nonterminal the least (cost, audit), the audit being the initials of the
edits; among equal costs the least string in ASCII. Intervals are combined bottom-up by their length. As
the nonterminals name both ends, every place at which an interval may be divided gives the same cell
(tests compare all divisions), so the chart needs the intervals of 1, 2, 4, ... rows and what is left at the end only.
That also lets Spark share out long conversations: a row is first reduced to one character (initial and
fault), intervals of `BLOCK` rows are parsed in tasks, then `FAN` neighbouring cells are combined per round.
No text takes part in the parse.

A repaired conversation is hashed as a whole, which no parallel sum can do: its rows come in order, in sorted
partitions, and are hashed as they pass, so memory is bounded although one conversation is read by one task.

Defined results: null conversation ids are one conversation, null roles and texts are one space, null turns
come first and count in no gap. Rows of the same turn are ordered by role and text. Repeated rows
are rows. A role without initial fits nowhere. A conversation without rows after damage gives zeros, an
empty audit and the hash of nothing. Very long conversations and texts are whole. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored
from quarry.operators.ranking import HOT_ROWS, group_position

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
# The pattern as steps between places: start, after system, after user, after assistant.
START, ENDS = 0, (0, 3)
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
PLACES = range(4)

# Characters that stand for a row: initial (s, u, a or other) by fault.
INITIALS = "sua?"
FAULTS = ("", "truncated", "blank", "duplicate")
CODES = "0123456789ABCDEF"

WHITE = " \t\n\x0b\x0c\r"
BLOCK = 4096
FAN = 32
# Texts of one turn in one block; only conversations of more than HOT_ROWS rows are cut by turn.
TURNS_IN_BLOCK = 10_000
LETTERS_AT_ONCE = 65_536

Cell = tuple[int, str]
Cells = dict[tuple[int, int], Cell]


def better(cells: Cells, at: tuple[int, int], cell: Cell) -> None:
    if at not in cells or cell < cells[at]:
        cells[at] = cell


def combined(left: Cells, right: Cells) -> Cells:
    """Cells of two neighbouring intervals as one: [p, q] -> [p, r] [r, q]."""
    out: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for q in PLACES:
            other = right.get((r, q))
            if other:
                better(out, (p, q), (cost + other[0], audit + other[1]))
    return out


def insertions() -> Cells:
    """Cells of no row: all least ways to insert, by closure."""
    cells: Cells = {(p, p): (0, "") for p in PLACES}
    step = dict(cells)
    for (initial, p), q in STEPS.items():
        if initial in ROLES:
            step[(p, q)] = (INSERT, "I")
    for _ in PLACES:
        cells = combined(cells, step)
    return cells


NOTHING = insertions()


def leaf(code: str) -> Cells:
    """Cells of one row, closed under insertions on both sides."""
    fault, initial = FAULTS[CODES.index(code) // 4], INITIALS[CODES.index(code) % 4]
    cells: Cells = {(p, p): (DELETE, "D") for p in PLACES}
    if fault in ("", "truncated"):
        more = TRUNCATED if fault else 0
        for (name, p), q in STEPS.items():
            if name == initial:
                better(cells, (p, q), (KEEP + more, "K"))
            if name in ROLES:
                better(cells, (p, q), (REROLE + more, "R"))
    return combined(combined(NOTHING, cells), NOTHING)


LEAVES = {code: leaf(code) for code in CODES}


def merged(intervals: Sequence[Cells]) -> Cells:
    """The chart over neighbouring intervals, by length: pairs, pairs of pairs, and so on."""
    while len(intervals) > 1:
        pairs = [combined(intervals[i], intervals[i + 1]) for i in range(0, len(intervals) - 1, 2)]
        intervals = pairs + list(intervals[len(pairs) * 2 :])
    return intervals[0] if intervals else NOTHING


@lru_cache(maxsize=4096)
def parsed(codes: str) -> Cells:
    return merged([LEAVES[c] for c in codes])


def best(cells: Cells) -> Cell:
    """Least (cost, audit) of a whole conversation."""
    return min(cells[START, q] for q in ENDS if (START, q) in cells)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, copy) with faults put in by a checksum of conversation and turn.

    By remainder of 20: 0 drops the row, 1 empties its text, 2 takes out `.`, `!` and `?`, 3 repeats it, 4 makes its role user.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = (F.crc32(name) % 20).cast("int")
    rows = conversations.select(F.struct("conv_id").alias("conv"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.filter("kind <> 0").select("conv", "turn", role, text, copies)


def numbered(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add `pos`, the place of each row (conv, turn, role, text, copy) in its conversation, from 1."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    block = F.coalesce(F.floor(F.col("turn") / TURNS_IN_BLOCK), F.lit(-(1 << 62)).cast("long"))
    return group_position(rows, ["conv"], order, block, "pos", hot_rows)


def faults(rows: DataFrame) -> DataFrame:
    """conv, pos and the character that stands for each numbered row."""
    initial = F.when(F.substring("role", 1, 1).isin(*INITIALS[:3]), F.substring("role", 1, 1)).otherwise(INITIALS[3])
    said = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    facts = rows.select("conv", "pos", (F.instr(F.lit(INITIALS), initial) - 1).alias("initial"), said.alias("said"), content.alias("content"))
    first = facts.filter("said <> ''").groupBy("conv", "content").agg(F.min("pos").alias("first"))
    judged = facts.join(first, ["conv", "content"], "left")
    fault = F.when(F.col("said") == "", 2).when(F.col("pos") > F.col("first"), 3).when(~F.col("said").isin(".", "!", "?"), 1).otherwise(0)
    return judged.select("conv", "pos", F.substring(F.lit(CODES), fault * 4 + F.col("initial") + 1, F.lit(1)).alias("code"))


CELLS = "first string, last string, illegal long, cells array<struct<p: int, q: int, cost: long, audit: string>>"


def illegal_pairs(codes: str) -> int:
    """Neighbouring rows whose initials are none of su, ua, au."""
    initials = [INITIALS[CODES.index(c) % 4] for c in codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def parse(codes: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """conv, cost, audit, illegal per conversation of `codes` (conv, pos, code): blocks of rows, then of cells, until one is left."""
    conv = codes.schema["conv"].dataType.simpleString()
    schema = f"conv {conv}, block long, {CELLS}"
    names = ["conv", "block", "first", "last", "illegal", "cells"]

    def row(conv: dict, number: int, first: str, last: str, illegal: int, cells: Cells) -> dict:
        flat = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cells.items()]
        return dict(zip(names, (conv, number, first, last, illegal, flat)))

    def batch(rows: list[dict], like: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        types = [like.schema.field("conv").type, pa.int64(), pa.string(), pa.string(), pa.int64(), kind]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = part.to_pylist()
            yield batch([row(r["conv"], r["block"], r["codes"][0], r["codes"][-1], illegal_pairs(r["codes"]), parsed(r["codes"])) for r in rows], part)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for r in part.to_pylist():
                parts = r["parts"]
                cells = [{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in p["cells"]} for p in parts]
                seams = sum(illegal_pairs(a["last"] + b["first"]) for a, b in zip(parts, parts[1:]))
                out.append(row(r["conv"], r["block"], parts[0]["first"], parts[-1]["last"], seams + sum(p["illegal"] for p in parts), merged(cells)))
            yield batch(out, part)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [best({(c["p"], c["q"]): (c["cost"], c["audit"]) for c in cells}) for cells in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), part.column(2)],
                names=["conv", "cost", "audit", "illegal"],
            )

    in_order = F.array_sort(F.collect_list(F.struct("pos", "code")))
    blocks = codes.groupBy("conv", F.floor((F.col("pos") - 1) / block).alias("block")).agg(in_order.alias("rows"))
    strings = blocks.select("conv", "block", F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes"))
    cells = stored(strings.mapInArrow(leaves, schema), "repair-cells")
    last = cells.agg(F.max("block")).first()[0] or 0
    while last > 0:
        parts = F.array_sort(F.collect_list(F.struct("block", "first", "last", "illegal", "cells")))
        groups = cells.groupBy("conv", F.floor(F.col("block") / fan).alias("up")).agg(parts.alias("parts"))
        cells = stored(groups.select("conv", F.col("up").alias("block"), "parts").mapInArrow(joined, schema), "repair-cells")
        last //= fan
    return cells.select("conv", "block", "illegal", "cells").mapInArrow(whole, f"conv {conv}, cost long, audit string, illegal long")


def edits(repairs: DataFrame) -> DataFrame:
    """(conv, seq, pos, new_role) of every row of the repaired conversations; `pos` is null for inserted rows, the role for kept ones."""
    conv = repairs.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, audit in enumerate(batch.column(1).to_pylist()):
                # An odd number of rows begins with a system row; users and assistants take turns.
                turn, pos = -1 if (len(audit) - audit.count("D")) % 2 else 0, 0
                for start in range(0, len(audit), LETTERS_AT_ONCE):
                    seqs, places, roles = [], [], []
                    for seq, letter in enumerate(audit[start : start + LETTERS_AT_ONCE], start):
                        pos += letter != "I"
                        if letter == "D":
                            continue
                        seqs.append(seq)
                        places.append(None if letter == "I" else pos)
                        roles.append(None if letter == "K" else ROLES["ua"[turn % 2]])
                        turn += 1
                    rows = pa.array([i] * len(seqs), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), pa.array(seqs, pa.int64()), pa.array(places, pa.int64()), pa.array(roles, pa.string())],
                        names=["conv", "seq", "pos", "new_role"],
                    )

    return repairs.select("conv", "audit").mapInArrow(run, f"conv {conv}, seq long, pos long, new_role string")


def repaired_lines(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv, seq, line): the repaired conversations as `role:text` lines."""
    made = edits(repairs)
    line = F.concat(F.coalesce("new_role", "role"), F.lit(":"), "text").alias("line")
    old = made.filter("pos IS NOT NULL").join(rows.select("conv", "pos", "role", "text"), ["conv", "pos"]).select("conv", "seq", line)
    return old.unionByName(made.filter("pos IS NULL").select("conv", "seq", F.concat("new_role", F.lit(":")).alias("line")))


def hashes(lines: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the lines of each conversation, joined by line ends, as they stream by in order."""
    conv = lines.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, kind = None, None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv").type
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if digest is not None and key == now:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        yield result()
                    now, digest = key, hashlib.sha256()
                digest.update(line)
        if digest is not None:
            yield result()

    in_order = lines.repartition("conv").sortWithinPartitions("conv", "seq")
    return in_order.select("conv", "line").mapInArrow(run, f"conv {conv}, repaired_sha256 string")


def repair(conversations: DataFrame, rows: DataFrame, block: int = BLOCK, fan: int = FAN, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per conversation of `conversations`: faults, least cost, audit and hash of the repaired `rows` (of `damaged`)."""
    rows = stored(numbered(rows, hot_rows), "repair-rows")
    codes = stored(faults(rows), "repair-codes")
    repairs = stored(parse(codes, block, fan), "repair-audits")
    place = F.instr(F.lit(CODES), F.col("code")) - 1
    count = {name: F.count_if(F.floor(place / 4) == FAULTS.index(name)).alias(name) for name in ("blank", "duplicate", "truncated")}
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = codes.groupBy("conv").agg(*count.values())
    spans = rows.groupBy("conv").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"))
    all_ids = conversations.select(F.struct("conv_id").alias("conv")).distinct()
    found = all_ids
    for part in (spans, counts, repairs, hashes(repaired_lines(rows, repairs))):
        found = found.join(part, "conv", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return found.select(
        F.col("conv.conv_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
