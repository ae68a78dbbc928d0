"""Repair of the structure of conversations with the fewest edits.

The rows of a conversation, in order of turn, become a legal dialog: nothing, or pairs of user and
assistant, with one system row in front at most. Edits and what they cost: keep a row (0), give it the
role user or assistant (2), delete it (3), insert an empty row of user or assistant anywhere (2). Blank
and repeated rows must be deleted; a truncated row that is not deleted adds 1. Of the cheapest edits
those are taken whose initials D, I, K, R, read as a string, come first.

One integer holds both: its high digits are the cost, its low digits, three bits each and as many as
the string can be long, are the letters from the left with zeros behind the last. The place of the
next letter is the one below the lowest digit that is not zero. Ordinary integer minimum over the paths
of the acyclic graph of (row, state) then finds cost and string together, the states being what may
come next: nothing seen, after system, after user, after assistant. Paths of equal cost over the same
rows are never one the beginning of the other, since each letter has a fixed cost; so minima over parts
of a conversation can be joined, and a long one is worked on in parts of ``UNIT`` places, each a matrix
of integers from state to state. Matrices are multiplied in rounds of 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricon.llm.common import SPACE, id_of, shown_id
from rubricon.operators.grouping import ranked
from rubricon.session import stored

UNIT = 4096
PART_ROWS = 128
FAN = 64
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, KEEP, REROLE = range(1, 5)
LETTERS = str.maketrans("1234", "DIKR")
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: Faults of a row, the first that holds.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
AFTER = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}


class Paths:
    """For each state a path may start in, the least integer that ends in each state.

    ``width`` letters have their places below the cost. ``paths[s]`` is a dict of end state to integer.
    """

    def __init__(self, width: int, paths: dict[int, dict[int, int]] | None = None):
        self.width = width
        self.paths = paths if paths is not None else {s: {s: 0} for s in range(4)}

    def _free(self, value: int) -> int:
        """The lowest bit of the next letter's place."""
        return _unused(value, self.width) - 3

    def _add(self, value: int, letter: int, cost: int) -> int:
        return value + (cost << 3 * self.width) + (letter << self._free(value))

    def _removed(self, value: int, times: int) -> int:
        """The path with a run of deletions behind it."""
        run = ((1 << 3 * times) - 1) // 7
        return value + (3 * times << 3 * self.width) + (run << self._free(value) - 3 * (times - 1))

    def inserted(self) -> Paths:
        """With empty rows put in wherever they lead to another state more cheaply."""
        for ends in self.paths.values():
            for role in "ua":
                for before, after in AFTER[role].items():
                    if before in ends:
                        _keep_least(ends, after, self._add(ends[before], INSERT, COST[INSERT]))
        return self

    def row(self, initial: str, fault: int, copies: int) -> None:
        """Go on by a row and its further copies, which can only be deleted."""
        self.inserted()
        more = fault == TRUNCATED
        for start, ends in self.paths.items():
            on: dict[int, int] = {}
            for state, value in ends.items():
                on[state] = self._add(value, DELETE, COST[DELETE])
            if fault not in (BLANK, DUPLICATE):
                for role in "ua":
                    for before, after in AFTER[role].items():
                        if before in ends:
                            _keep_least(on, after, self._add(ends[before], REROLE, COST[REROLE] + more))
                for before, after in AFTER.get(initial, {}).items():
                    if before in ends:
                        _keep_least(on, after, self._add(ends[before], KEEP, COST[KEEP] + more))
            if copies > 1:
                on = {state: self._removed(value, copies - 1) for state, value in on.items()}
            self.paths[start] = on

    def times(self, other: Paths) -> Paths:
        """Paths through both parts."""
        width, low = self.width + other.width, (1 << 3 * self.width) - 1
        tail = (1 << 3 * other.width) - 1
        out: dict[int, dict[int, int]] = {}
        for start, ends in self.paths.items():
            on: dict[int, int] = {}
            for middle, value in ends.items():
                letters = value & low
                unused = _unused(letters, self.width)
                head, cost = letters << 3 * other.width, value >> 3 * self.width
                for state, rest in other.paths[middle].items():
                    joined = head + ((rest & tail) << unused) + ((cost + (rest >> 3 * other.width)) << 3 * width)
                    _keep_least(on, state, joined)
            out[start] = on
        return Paths(width, out)

    def best(self) -> tuple[int, str]:
        """Cost and letters of the best path from nothing to a legal end."""
        ends = self.inserted().paths[NOTHING]
        value = min(ends[s] for s in (NOTHING, ASSISTANT) if s in ends)
        letters = value & ((1 << 3 * self.width) - 1)
        return value >> 3 * self.width, f"{letters:o}".rstrip("0").translate(LETTERS) if letters else ""

    def packed(self) -> list[bytes | None]:
        flat = [self.paths[s].get(e) for s in range(4) for e in range(4)]
        return [None if v is None else v.to_bytes((v.bit_length() + 7) // 8, "little") for v in flat]

    @classmethod
    def unpacked(cls, width: int, flat: list[bytes | None]) -> Paths:
        value = lambda b: int.from_bytes(b, "little")
        return cls(width, {s: {e: value(b) for e, b in enumerate(flat[4 * s : 4 * s + 4]) if b is not None} for s in range(4)})


def _unused(letters: int, width: int) -> int:
    """The bits below the last letter. A path without letters costs nothing and is zero."""
    return ((letters & -letters).bit_length() - 1) // 3 * 3 if letters else 3 * width


def _keep_least(ends: dict[int, int], state: int, value: int) -> None:
    if state not in ends or value < ends[state]:
        ends[state] = value


def part_paths(rows: list[tuple[str, int, int]]) -> Paths:
    """Paths through rows of (initial, fault, copies). Two places are kept for insertions, at the end
    of a conversation too."""
    paths = Paths(sum(copies + 2 for _, _, copies in rows) + 2)
    for row in rows:
        paths.row(*row)
    return paths


class Part:
    """Counts and paths of a stretch of a conversation."""

    def __init__(self, counts: list[int], first: str, last: str, paths: Paths):
        self.counts, self.first, self.last, self.paths = counts, first, last, paths

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]]) -> Part:
        counts, before = [0, 0, 0, 0], None
        for initial, fault, copies in rows:
            if fault == BLANK:
                counts[0] += copies
            else:
                # The first copy has the fault of the row, the others repeat it.
                counts[1] += copies - (fault != DUPLICATE)
                counts[2] += fault == TRUNCATED
            counts[3] += copies - 1 + (before is not None and before + initial not in LEGAL)
            before = initial
        return cls(counts, rows[0][0], rows[-1][0], part_paths(rows))

    def times(self, other: Part) -> Part:
        counts = [a + b for a, b in zip(self.counts, other.counts)]
        counts[3] += self.last + other.first not in LEGAL
        return Part(counts, self.first, other.last, self.paths.times(other.paths))


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_PART = "conv long, unit long, blank long, duplicate long, truncated long, illegal long, first string, last string, width long, paths array<binary>"
_PART_ARROW = pa.schema(
    [("conv", pa.int64()), ("unit", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("first", pa.string()), ("last", pa.string()), ("width", pa.int64()), ("paths", pa.list_(pa.binary()))]
)


def _part_rows(held: list[tuple[int, int, Part]]) -> pa.RecordBatch:
    rows = [[c, u, *p.counts, p.first, p.last, p.paths.width, p.paths.packed()] for c, u, p in held]
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows), _PART_ARROW)], schema=_PART_ARROW)


def _folded(keyed: Iterator[tuple[tuple[int, int], Part]]) -> Iterator[pa.RecordBatch]:
    """One part per key from parts in order."""
    key, part, done = None, None, []
    for at, found in keyed:
        if at != key:
            if part is not None:
                done.append((*key, part))
            if len(done) >= 1000:
                yield _part_rows(done)
                done = []
            key, part = at, found
        else:
            part = part.times(found)
    if part is not None:
        done.append((*key, part))
    if done:
        yield _part_rows(done)


def _parts_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (conv, unit, initial, fault, copies) in order to one part for every conversation and unit."""

    def parts() -> Iterator[tuple[tuple[int, int], Part]]:
        key, rows = None, []
        for batch in batches:
            for conv, unit, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (conv, unit) != key or len(rows) == PART_ROWS:
                    if rows:
                        yield key, Part.of(rows)
                    key, rows = (conv, unit), []
                rows.append(tuple(row))
        if rows:
            yield key, Part.of(rows)

    return _folded(parts())


def _parts_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order, their key (conv, next) behind them, to one part for every key."""

    def parts() -> Iterator[tuple[tuple[int, int], Part]]:
        for batch in batches:
            for row in batch.to_pylist():
                paths = Paths.unpacked(row["width"], row["paths"])
                yield (row["conv"], row["next"]), Part([row[c] for c in _COUNTS], row["first"], row["last"], paths)

    return _folded(parts())


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Paths.unpacked(w, p).best() for w, p in zip(batch.column("width").to_pylist(), batch.column("paths").to_pylist())]
        cost, audit = zip(*found) if found else ((), ())
        columns = [batch.column(c) for c in ["conv", *_COUNTS]] + [pa.array(cost, pa.int64()), pa.array(audit, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", *_COUNTS, "cost", "audit"])


def replayed(audit: str, lines: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str]]:
    """Role and text of the rows that the edits of an audit leave of (role, text, copies)."""
    state, letters = NOTHING, iter(audit)

    def put(role: str) -> str:
        nonlocal state
        state = AFTER[role[:1]][state]
        return role

    def due() -> str:
        return "assistant" if state == USER else "user"

    for role, text, copies in lines:
        for _ in range(copies):
            for letter in letters:
                if letter != "I":
                    break
                yield put(due()), ""
            if letter != "D":
                yield put(role if letter == "K" else due()), text
    for _ in letters:
        yield put(due()), ""


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[str, str]]]]:
    """Rows (conv, place, role, text, copies) in order, each conversation headed by a row without a role
    whose text is the audit: its id and repaired rows, to be read before the next."""
    rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5))))
    head = next(rows, None)
    while head is not None:
        conv, audit, head = head[0], head[3], None

        def lines() -> Iterator[tuple[str, str, int]]:
            nonlocal head
            for row in rows:
                if row[2] is None:
                    head = row
                    return
                yield row[2:]

        yield conv, replayed(audit, lines())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for conv, rows in _conversations(batches):
        digest, join = hashlib.sha256(), b""
        for role, text in rows:
            digest.update(join + f"{role}:{text}".encode())
            join = b"\n"
        held.append((conv, digest.hexdigest()))
        if len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], names=["conv", "digest"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], names=["conv", "digest"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "place", "role", "text"]
    make = lambda held: pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], names=names)
    held = []
    for conv, rows in _conversations(batches):
        for place, (role, text) in enumerate(rows):
            held.append((conv, place, role, text))
            if len(held) >= 1000:
                yield make(held)
                held = []
    if held:
        yield make(held)


def fault(text: Column, again: Column) -> Column:
    """The first fault of a row, or zero: blank, seen before, or without a mark at its end."""
    spaces = F.lit(" \t\n\x0b\f\r")
    bare = F.rtrim(text, spaces)
    cut = ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    return F.when(bare == "", BLANK).when(again, DUPLICATE).when(cut, TRUNCATED).otherwise(0)


def lines(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies, fault, place: equal rows as one, in the order of the table, as a
    stored table. ``rows`` has conv_id, turn, role, text and copies, none of them null but conv_id and turn.

    Rows of a conversation are in order of turn, null ones first; rows that share a turn, of role and
    text. Equal rows are counted before they move, and a row that comes later again is found by its
    hash, so that no repeated row gathers anywhere.
    """
    flat = rows.where("copies > 0").groupBy(id_of("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    flat = stored(flat.agg(F.sum("copies").cast("long").alias("copies")), "lines")
    flat = flat.withColumn("hash", F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = flat.groupBy("conv", "hash").agg(F.min(order).alias("seen"), F.count(F.lit(1)).alias("turns"))
    known = flat.join(seen.where("turns > 1").drop("turns"), ["conv", "hash"], "left")
    again = F.coalesce(order > F.col("seen"), F.lit(False))
    known = known.select("conv", "turn", "role", "text", "copies", fault(F.col("text"), again).alias("fault"))
    # Beginnings of texts are enough to part ranges and keep the driver's sample small.
    start = known.withColumn("start", F.left("text", F.lit(32)))
    return ranked(start, ["conv", "turn", "role", "start"], "place", within=["text"]).drop("start")


def audits(found: DataFrame) -> DataFrame:
    """conv, blank, duplicate, truncated, illegal, cost, audit of every conversation of ``lines``."""
    last = found.agg(F.max("place")).first()[0] or 0
    unit = F.col("place") - F.col("place") % UNIT
    short = found.select("conv", (unit / UNIT).cast("long").alias("unit"), F.left("role", F.lit(1)).alias("initial"), "fault", "copies", "place")
    dealt = short.repartition("conv", "unit").sortWithinPartitions("conv", "unit", "place").drop("place")
    parts, units = dealt.mapInArrow(_parts_of_lines, _PART), last // UNIT
    while units:
        dealt = parts.withColumn("next", F.expr(f"unit div {FAN}")).repartition("conv", "next")
        parts, units = dealt.sortWithinPartitions("conv", "unit").mapInArrow(_parts_of_parts, _PART), units // FAN
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return parts.mapInArrow(_audits, f"conv long, {counts}, cost long, audit string")


def _headed(found: DataFrame, audited: DataFrame) -> DataFrame:
    """Lines and, before those of every conversation, its audit, in order within partitions."""
    none = F.lit(None).cast("string")
    heads = audited.select("conv", F.lit(-1).cast("long").alias("place"), none.alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"))
    both = found.select("conv", "place", "role", "text", "copies").unionByName(heads)
    return both.repartition("conv").sortWithinPartitions("conv", "place")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of every row that repair leaves or puts in.

    For rows as ``lines`` takes them. One task reads the lines of a conversation in order.
    """
    found = lines(rows)
    out = _headed(found, audits(found)).mapInArrow(_texts, "conv long, place long, role string, text string")
    return out.select(shown_id("conv").alias("conv_id"), "place", "role", "text")


def repaired(rows: DataFrame) -> DataFrame:
    """What repair finds and does in every conversation: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit and digest (sha256 of the repaired ``role:text`` rows, joined by newlines).

    ``rows`` has conv_id, turn, role, text and copies; conversations whose rows all have no copies are
    returned too, with zeros. Null ids make a conversation of their own; null turns come first and do
    not count for gaps, the turns missing between the least and the greatest. Rows that share a turn
    are in order of role, then text. Other columns are not read. An empty table gives an empty one.

    A conversation is split over tasks but for its digest, which one task computes, row by row, since
    sha256 runs over them in order.
    """
    found = lines(rows)
    audited = stored(audits(found), "audits")
    digests = _headed(found, audited).mapInArrow(_digests, "conv long, digest string")
    turns = found.select("conv", "turn").distinct().groupBy("conv")
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    gaps = turns.agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    every = rows.select(id_of("conv_id").alias("conv")).distinct()
    all_ = every.join(gaps, "conv", "left").join(audited, "conv", "left").join(digests, "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return all_.select(
        shown_id("conv").alias("conv_id"),
        *[zero(c) for c in ["gaps", *_COUNTS, "cost"]],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("digest"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of rows that are dropped (no copies), emptied, stripped of
    their marks, repeated, or given to the user, by the crc32 of conversation and turn. A null is read
    as one space; conv_id and turn keep theirs."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(blank("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
