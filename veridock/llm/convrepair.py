"""Conversation structure repair: cheapest edits that give every conversation the form system?, (user, assistant)+, or nothing.

1. Each row gets its role's initial and its first fault: blank, duplicate (role and text seen earlier in the conversation) or
   truncated. A conversation is its sequence of these, one character a row: s, u, a or o for the role, a capital if truncated, x
   if it must go. Rows without their texts do this; equal rows are counted, not kept apart.
2. Sequences are cut into parts of at most 128 rows, the signatures. Each distinct signature is solved once, by memoised
   recursion over (row, state of the form): least cost and, of equal costs, the ASCII-least audit from each state to each.
   Almost all conversations are one part.
3. Solutions are joined back, and one pass over parts and texts in order, each conversation in one task but never held in
   memory as a whole, composes them and replays the edits. Costs add up over parts, and as neither of two audits of the same
   rows is the beginning of the other, so does their order, so that the composed audit is the cheapest and least as a whole.

Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3 (blank and duplicate rows have no other way), Insert of an empty row 2;
a truncated row that stays adds 1. What an edit puts in is given by the place, so an audit says all of it.

Defined cases: null roles and texts are one space; rows without a turn come first; rows of one turn are ordered by role and
then by the SHA-256 of the text; rows that repeat another in everything are duplicates of it; rows without conv_id are one
conversation; a role is judged by its first character, and an empty role fits nowhere; a conversation that lost all rows has
zeros, an empty audit and the digest of nothing; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.llm.common import BATCH_ROWS, arrow_map, table, written

#: Rows of a part; the recursion is as deep.
PART_ROWS = 128
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANKS = " \t\n\x0b\f\r"

#: The form as an automaton: nothing yet, after the system row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The state after a user or assistant row put in by the place, the role put there, and what ends a conversation.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}

_CONV = ("_k", "_none")
_PARTS = "_k long, _none boolean, part int, seq int, signature string, n_blank long, n_duplicate long, n_truncated long, n_illegal long, head string, tail string, low long, high long, turns long"


# ------------------------------------------------------------------------------------------------------------- signatures


def after(state: int, role: str) -> int | None:
    """The state that a row of this role, kept in its place, leads to."""
    if role == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if role == ROLE[state][0] else None


def solve(signature: str) -> tuple[list[int], list[str]]:
    """Least cost and audit from each state to each (16 of them, by start and then end; -1 where there is no way). Rows are put in
    before a row only, which leaves those at the end to the next part or to the conversation's end."""

    @cache
    def best(at: int, state: int) -> dict[int, tuple[int, str]]:
        if at == len(signature):
            return {state: (0, "")}
        row, found = signature[at], {}
        role, extra = row.lower(), TRUNCATED * row.isupper()
        put = ""
        for _ in range(3):
            ways = [("D", DELETE, state)]
            if row != "x":
                ways.append(("R", REROLE + extra, NEXT[state]))
                if (kept := after(state, role)) is not None:
                    ways.append(("K", KEEP + extra, kept))
            for letter, cost, to in ways:
                for end, (rest, audit) in best(at + 1, to).items():
                    way = (INSERT * len(put) + cost + rest, put + letter + audit)
                    found[end] = min(found.get(end, way), way)
            put, state = put + "I", NEXT[state]
        return found

    costs, audits = [], []
    for start in STATES:
        ways = best(0, start)
        for end in STATES:
            cost, audit = ways.get(end, (-1, ""))
            costs.append(cost)
            audits.append(audit)
    return costs, audits


class _Solve:
    schema = "signature string, costs array<int>, audits array<string>"

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures = batch.column("signature").to_pylist()
            solved = [solve(s) for s in signatures]
            yield pa.RecordBatch.from_arrays([pa.array(signatures, pa.string()), pa.array([c for c, _ in solved], pa.list_(pa.int32())), pa.array([a for _, a in solved], pa.list_(pa.string()))], names=["signature", "costs", "audits"])


class Composition:
    """The parts of one conversation in order: for each state the least cost so far and its audit, as a chain of the parts'
    audits. ``place`` orders the states' audits among each other, so that ties never need the whole of them."""

    def __init__(self) -> None:
        self.ways: dict[int, tuple[int, int, object]] = {START: (0, 0, None)}

    def add(self, costs: list[int], audits: list[str]) -> None:
        found: dict[int, tuple[int, int, str, object]] = {}
        for start, (cost, place, chain) in self.ways.items():
            for end in STATES:
                k = 4 * start + end
                if costs[k] >= 0:
                    way = (cost + costs[k], place, audits[k])
                    if end not in found or way < found[end][:3]:
                        found[end] = (*way, chain)
        order = sorted(found, key=lambda end: found[end][1:3])
        self.ways = {end: (found[end][0], place, (found[end][3], found[end][2])) for place, end in enumerate(order)}

    def result(self) -> tuple[int, str]:
        cost, _, state, chain = min((c + INSERT * CLOSING[s], p, s, x) for s, (c, p, x) in self.ways.items())
        pieces = ["I" * CLOSING[state]]
        while chain:
            chain, piece = chain
            pieces.append(piece)
        return cost, "".join(reversed(pieces))


# ------------------------------------------------------------------------------------------------------------ rows and faults


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as the damage leaves them, by the checksum of ``conv_id:turn``: conv_id, turn, role, text."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    conv = F.col("conv_id").cast("long")
    return rows.select(F.coalesce(conv, F.lit(0)).alias("_k"), conv.isNull().alias("_none"), F.col("turn").cast("long").alias("turn"), fill("role"), fill("text"))


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number, without texts: key, turn, role, digest, blank, truncated, ``first`` (this is the earliest turn
    of the role and text), n."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    light = _keyed(rows).select(*_CONV, "turn", "role", _digest("text").alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    same = light.groupBy(*_CONV, "turn", "role", "digest", "blank", "truncated").agg(F.count("*").alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    earliest = same.groupBy(*_CONV, "role", "digest").agg(F.min(turn).alias("_first"))
    return same.join(earliest, [*_CONV, "role", "digest"]).withColumn("first", turn == F.col("_first")).drop("_first")


class _Parts:
    """Rows in order to parts of at most PART_ROWS rows, with what they add to the conversation's counts."""

    schema = _PARTS

    def __init__(self, size: int):
        self.size = size

    def rows(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k, none, turn, role, blank, truncated, first, n in zip(*(batch.column(c).to_pylist() for c in ("_k", "_none", "turn", "role", "blank", "truncated", "first", "n")), strict=True):
                for copy in range(n):
                    yield (k, none), turn, role, blank, truncated, not first or copy > 0

    def parts(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        number, seq, key, part = TaskContext.get().partitionId(), 0, None, None
        for conv, turn, role, blank, truncated, again in self.rows(batches):
            if part and (conv != key or len(part["signature"]) >= self.size):
                yield self.closed(key, number, seq, part)
                seq, part = seq + 1, None
            key, initial = conv, role[:1]
            if part is None:
                part = {"signature": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "head": initial, "turns": 0, "low": None, "high": None}
            elif part["tail"] + initial not in ("su", "ua", "au"):
                part["illegal"] += 1
            part["tail"] = initial
            if turn is not None and turn != part["high"]:
                part["turns"] += 1
                part["low"], part["high"] = turn if part["low"] is None else part["low"], turn
            fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
            if fault:
                part[fault] += 1
            letter = initial if initial and initial in "sua" else "o"
            part["signature"].append("x" if blank or again else letter.upper() if truncated else letter)
        if part:
            yield self.closed(key, number, seq, part)

    @staticmethod
    def closed(key: tuple, number: int, seq: int, part: dict) -> tuple:
        return (*key, number, seq, "".join(part["signature"]), *(part[x] for x in ("blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "turns")))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]
        yield from _batched(self.parts(batches), kinds, [c.split()[0] for c in self.schema.split(", ")])


def _batched(rows: Iterable[tuple], kinds: list[pa.DataType], names: list[str], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= BATCH_ROWS or size >= most_bytes:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def parts(rows: DataFrame, size: int = PART_ROWS) -> DataFrame:
    """The signatures of all conversations, in order. Rows are dealt out by ranges of conversation and turn, so a large conversation
    is read by many tasks; as the ranges come from a sample, the parts are stored before anything refers to them."""
    order = [*_CONV, "turn", "role", "digest"]
    dealt = faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(arrow_map(dealt, _Parts(size), _PARTS), "parts")


def solved(cut: DataFrame) -> DataFrame:
    """Parts with costs and audits between all states; each distinct signature is solved once."""
    ways = arrow_map(cut.select("signature").distinct(), _Solve(), _Solve.schema)
    return cut.join(ways, "signature").drop("signature")


# --------------------------------------------------------------------------------------------------------------------- replay


class _Replay:
    """Each conversation in order: its marker, its parts, its rows. ``finish`` makes rows from the record and the repaired rows."""

    def __init__(self, finish: Callable[[dict, Iterator[tuple]], Iterator[tuple]], kinds: list[pa.DataType], names: list[str]):
        self.finish, self.kinds, self.names = finish, kinds, names

    @staticmethod
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        names = ("_k", "_none", "tag", "counts", "head", "tail", "low", "high", "costs", "audits", "role", "text")
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)

    @staticmethod
    def repaired(audit: str, texts: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
        state = START
        for letter in audit:
            if letter == "I":
                role, text = ROLE[state], ""
            else:
                role, text = next(texts)
                if letter == "D":
                    continue
                if letter == "R":
                    role = ROLE[state]
            state = SYSTEM if letter == "K" and role[:1] == "s" else NEXT[state]
            yield letter, role, text

    def conversations(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        stream, ahead = self.rows(batches), None
        ahead = next(stream, None)
        while ahead:
            key = ahead[:2]
            record, ways, tail, high, turns, low = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), Composition(), None, None, 0, None
            while ahead and ahead[:2] == key and ahead[2] < 2:
                if ahead[2] == 1:
                    _, _, _, counts, head, last, least, most, costs, audits, _, _ = ahead
                    for name, n in zip(record, counts, strict=False):
                        record[name] += n
                    record["illegal"] += tail is not None and tail + head not in ("su", "ua", "au")
                    turns += counts[4] - (least is not None and least == high)
                    tail, high, low = last, high if most is None else most, least if low is None else low
                    ways.add(costs, audits)
                ahead = next(stream, None)
            cost, audit = ways.result()
            record |= {"conv_id": None if key[1] else key[0], "gaps": 0 if low is None else high - low + 1 - turns, "cost": cost, "audit": audit}

            def texts(key: tuple = key) -> Iterator[tuple[str, str]]:
                nonlocal ahead
                while ahead and ahead[:2] == key:
                    row, ahead = ahead[10:12], next(stream, None)
                    yield row

            own = texts()
            yield from self.finish(record, self.repaired(audit, own))
            for _ in own:  # whatever the edits did not ask for
                pass

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(self.conversations(batches), self.kinds, self.names)


def _records(record: dict, rows: Iterator[tuple]) -> Iterator[tuple]:
    digest, between = hashlib.sha256(), b""
    for _, role, text in rows:
        digest.update(between + f"{role}:{text}".encode())
        between = b"\n"
    yield (*(record[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), digest.hexdigest())


def _texts(record: dict, rows: Iterator[tuple]) -> Iterator[tuple]:
    for place, (letter, role, text) in enumerate(rows):
        yield record["conv_id"], place, role, text, letter


def _replayed(rows: DataFrame, originals: DataFrame, replay: _Replay, schema: str, size: int) -> DataFrame:
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    conv = F.col("conv_id").cast("long")
    nothing = [none("array<long>", "counts"), none("string", "head"), none("string", "tail"), none("long", "low"), none("long", "high"), none("array<int>", "costs"), none("array<string>", "audits")]
    place = [none("int", "part"), none("int", "seq")]
    line = [none("long", "turn"), none("binary", "digest"), none("string", "role"), none("string", "text")]
    markers = originals.select(F.coalesce(conv, F.lit(0)).alias("_k"), conv.isNull().alias("_none")).distinct().select(*_CONV, F.lit(0).alias("tag"), *place, *line, *nothing)
    counts = F.array("n_blank", "n_duplicate", "n_truncated", "n_illegal", "turns").alias("counts")
    cut = solved(parts(rows, size)).select(*_CONV, F.lit(1).alias("tag"), "part", "seq", *line, counts, "head", "tail", "low", "high", "costs", "audits")
    texts = _keyed(rows).select(*_CONV, F.lit(2).alias("tag"), *place, "turn", _digest("text").alias("digest"), "role", "text", *nothing)
    every = markers.unionByName(cut).unionByName(texts)
    ordered = every.repartition(*_CONV).sortWithinPartitions(*_CONV, "tag", "part", "seq", "turn", "role", "digest")
    return arrow_map(ordered, replay, schema)


def audits(rows: DataFrame, originals: DataFrame | None = None, size: int = PART_ROWS) -> DataFrame:
    """One row for each conversation of ``originals`` (else of the rows): conv_id, gaps, the counts of faults and of illegal
    neighbours, cost and audit of the cheapest edits, and the SHA-256 of the repaired rows as ``role:text`` lines."""
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
    return _replayed(rows, rows if originals is None else originals, _Replay(_records, kinds, [c.split()[0] for c in schema.split(", ")]), schema, size)


def repaired(rows: DataFrame, size: int = PART_ROWS) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), role, text, edit (K, R or I)."""
    schema = "conv_id long, place long, role string, text string, edit string"
    return _replayed(rows, rows, _Replay(_texts, [pa.int64(), pa.int64(), *[pa.string()] * 3], [c.split()[0] for c in schema.split(", ")]), schema, size)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return audits(damaged(conversations), conversations)


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
SQL: dict[str, str] = {}
