"""Conversation structure repair: a forward Viterbi pass over each conversation's turns, in chunks that compose.

States are the grammar's: start, after system, after user, after assistant; a conversation is sound in the first and the
last. A turn is kept, given another role, or deleted; after each, turns with empty text may be inserted. A state
carries the least (cost, audit string), strings in the order of ASCII.

Edits determine costs, and both of two paths over the same turns hold one letter a turn beside their insertions, so of
two strings of equal cost neither begins the other. Hence the least stays least under whatever follows, and
passes over consecutive chunks compose: a chunk is a 4 x 4 table of (cost, audit), from each state before to each after.

1. Turns become narrow rows without texts: digest, initial of the role, fault. Equal rows are counted first
   (`narrow`), so a turn repeated any number of times is one row; the first place of each role and text in its
   conversation comes from a partial aggregate (`faults`).
2. Rows are dealt by ranges of (conversation, turn), so one conversation may spread over all tasks, and streamed in
   chunks of at most CHUNK rows, each of which gives its table (`chunks`). A conversation's first chunk has one row.
3. Chunks of a conversation are composed in order, one at a time (`compose`): costs, audit and the states at each seam.
4. Seams and chunks give every row its edit (`repair`), which is joined to the texts by digest.

Defined cases: null roles and texts are one space; null turns come first, null conv_ids are one conversation; turns of equal
number go by the digest of role and text; rows may repeat any number of times; empty and very long texts are taken
whole; an empty table gives empty results; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vartide.llm import common

CHUNK = 512
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: Grammar (s?(ua)+)? as states 0 start, 1 after system, 2 after user, 3 after assistant.
START, ENDS = 0, (0, 3)
#: What may follow a state: state and role initial of a kept turn.
KEEP = ((("s", 1), ("u", 2)), (("u", 2),), (("a", 3),), (("u", 2),))
#: The one turn that may be inserted after, or a turn be made into after, a state.
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
FAULTS = ("none", "blank", "duplicate", "truncated")

Cell = tuple[int, str] | None


def closed(cells: list[Cell]) -> list[Cell]:
    """One layer with the insertions after it: two at most, as a third comes back to where the first led."""
    for _ in range(2):
        new = list(cells)
        for state, cell in enumerate(cells):
            if cell is not None:
                to, made = NEXT[state], (cell[0] + INSERT, cell[1] + "I")
                if new[to] is None or made < new[to]:
                    new[to] = made
        cells = new
    return cells


def step(cells: list[Cell], initial: str, fault: int, n: int) -> list[Cell]:
    """The layer after n equal turns, the first of which has this fault; the others repeat it and go."""
    out: list[Cell] = [None] * 4
    keep = fault not in (1, 2)
    more, rest = TRUNCATED if fault == 3 else 0, "D" * (n - 1)

    def offer(to: int, cost: int, audit: str) -> None:
        if out[to] is None or (cost, audit) < out[to]:
            out[to] = (cost, audit)

    for state, cell in enumerate(cells):
        if cell is None:
            continue
        cost, audit = cell[0] + DELETE * (n - 1), cell[1]
        offer(state, cost + DELETE, f"{audit}D{rest}")
        if keep:
            offer(NEXT[state], cost + REROLE + more, f"{audit}R{rest}")
            for letter, to in KEEP[state]:
                if letter == initial:
                    offer(to, cost + more, f"{audit}K{rest}")
    return closed(out)


def product(a: list[Cell], table: list[list[Cell]]) -> tuple[list[Cell], list[int | None]]:
    """Layer a followed by a chunk: the new layer, and the state before the chunk for each of its states."""
    out: list[Cell] = [None] * 4
    via: list[int | None] = [None] * 4
    for i, cell in enumerate(a):
        for j, more in enumerate(table[i] if cell is not None else ()):
            if more is not None:
                made = (cell[0] + more[0], cell[1] + more[1])
                if out[j] is None or made < out[j]:
                    out[j], via[j] = made, i
    return out, via


def best_end(cells: list[Cell]) -> int:
    return min((cells[s], s) for s in ENDS if cells[s] is not None)[1]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations after the contract's damage, decided by the checksum of
    conv_id:turn; nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array_repeat(F.lit(0), 2)).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _keys() -> list[Column]:
    """said: digest of role and text; key: digest of the whole row."""
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("conv_id", "turn")])
    return [F.unhex(said).alias("said"), F.unhex(F.md5(F.concat(place, F.lit(":"), said).cast("binary"))).alias("key")]


def narrow(turns: DataFrame) -> DataFrame:
    """One row for each different row of turns (conv_id, turn, role, text): its digests, number n, role initial, and
    whether it is blank (1) or truncated (3)."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    rows = turns.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), fault.cast("int").alias("fault"), *_keys())
    return rows.groupBy("conv_id", "turn", "said", "key", "initial", "fault").agg(F.count("*").alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """rows of `narrow` with a fault of 2 where the same role and text stand earlier; each further copy of a row is a
    blank or duplicate, too, but is not a row of its own."""
    first = rows.groupBy("conv_id", "said").agg(F.min(F.struct("turn")).alias("first"))
    met = rows.alias("r").join(first.alias("f"), F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.said") == F.col("f.said")))
    fault = F.when((F.col("fault") != 1) & ~F.col("turn").eqNullSafe(F.col("first.turn")), F.lit(2)).otherwise(F.col("fault"))
    return met.select("r.conv_id", "turn", "r.said", "key", "initial", fault.alias("fault"), "n")


CHUNK_SCHEMA = """conv_id long, place struct<turn:long,said:binary>, until struct<turn:long,said:binary>, keys array<binary>, ns array<long>, initials string, cells array<string>, costs array<long>,
 n long, blank long, duplicate long, truncated long, illegal long, turns long, low long, first string, last string"""


class _Chunk:
    """Consecutive rows of one conversation: their table from the states before, and counts."""

    def __init__(self, starts: bool, row: tuple):
        self.conv, self.place = row[0], row[1:3]
        self.layers = {s: [(0, "") if k == s else None for k in range(4)] for s in range(4)}
        if starts:
            self.layers = {START: closed(self.layers[START])}
        self.keys, self.ns, self.initials, self.counts = [], [], [], [0, 0, 0, 0]
        self.illegal, self.turns, self.low, self.first, self.last, self.turn = 0, 0, None, row[4], None, None

    def add(self, row: tuple) -> None:
        _, turn, said, key, initial, fault, n = row
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += n - 1  # a role's initial twice is never legal
        self.counts[fault] += 1
        self.counts[1 if fault == 1 else 2] += n - 1
        self.layers = {s: step(cells, initial, fault, n) for s, cells in self.layers.items()}
        self.keys.append(key)
        self.ns.append(n)
        self.initials.append(initial if initial in ("s", "u", "a") else "-")
        self.turn, self.last, self.until = turn, initial, (turn, said)

    def row(self) -> dict:
        flat = [self.layers.get(s, [None] * 4)[k] for s in range(4) for k in range(4)]
        at = lambda p: {"turn": p[0], "said": p[1]}
        return {
            "conv_id": self.conv, "place": at(self.place), "until": at(self.until), "keys": self.keys, "ns": self.ns, "initials": "".join(self.initials),
            "cells": [c and c[1] for c in flat], "costs": [c and c[0] for c in flat], "n": sum(self.ns),
            "blank": self.counts[1], "duplicate": self.counts[2], "truncated": self.counts[3], "illegal": self.illegal, "turns": self.turns, "low": self.low, "first": self.first, "last": self.last,
        }


def _types(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def chunks(rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """CHUNK_SCHEMA: rows of `faults` in chunks; a chunk that may not begin its conversation starts from every state."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("said").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "said", "key", "initial", "fault", "n")
    types = _types(CHUNK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, begun, done = None, False, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                other = chunk is None or row[0] != chunk.conv
                if other or len(chunk.keys) >= most:
                    if chunk is not None:
                        done.append(chunk.row())
                    chunk = _Chunk(other and begun, row)  # the part's first conversation may go on from another part
                    begun = True
                chunk.add(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, types)
                done = []
        if chunk is not None:
            yield pa.RecordBatch.from_pylist([chunk.row()], types)

    return rows.mapInArrow(run, CHUNK_SCHEMA)


COMPOSED_SCHEMA = """conv_id long, place struct<turn:long,said:binary>, before int, after int, last boolean, n long, gaps long, blank long, duplicate long, truncated long, illegal long,
 cost long, audit string"""


def compose(parts: DataFrame) -> DataFrame:
    """COMPOSED_SCHEMA: for every chunk the states before and after it on its conversation's best path; with the last
    one of each conversation its figures. Chunks are read in order, one at a time; of a conversation only its
    four audit strings and a few numbers a chunk are held."""
    order = ["conv_id", F.col("place.turn").asc_nulls_first(), "place.said"]
    rows = parts.drop("keys", "ns", "initials").repartition("conv_id").sortWithinPartitions(*order)
    names, types = ("n", "blank", "duplicate", "truncated", "illegal"), _types(COMPOSED_SCHEMA)

    def results(conv: int | None, cells: list[Cell], seams: list[tuple], figures: dict) -> list[dict]:
        state, out = best_end(cells), []
        low, high = figures["low"], figures["high"]
        gaps = 0 if low is None else high - low + 1 - figures["turns"]
        told = {k: figures[k] for k in names} | {"gaps": gaps, "cost": cells[state][0], "audit": cells[state][1]}
        for k, (place, via) in enumerate(reversed(seams)):
            out.append({"conv_id": conv, "place": place, "before": via[state], "after": state, "last": not k} | (told if not k else {}))
            state = via[state]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seams, done = None, [], []
        for b in batches:
            for r in b.to_pylist():
                if not seams or r["conv_id"] != conv:
                    if seams:
                        done += results(conv, cells, seams, figures)  # noqa: F821
                    conv, seams, cells, last = r["conv_id"], [], closed([(0, ""), None, None, None]), None
                    figures = dict.fromkeys(names, 0) | {"turns": 0, "low": None, "high": None}
                table = [[None if r["costs"][4 * i + j] is None else (r["costs"][4 * i + j], r["cells"][4 * i + j]) for j in range(4)] for i in range(4)]
                if not seams and table[START] != [None] * 4 and all(t == [None] * 4 for t in table[1:]):
                    cells = [(0, ""), None, None, None]  # the insertions before the first turn are in the chunk
                cells, via = product(cells, table)
                seams.append((r["place"], via))
                for k in names:
                    figures[k] += r[k]
                if last is not None and last + r["first"] not in ("su", "ua", "au"):
                    figures["illegal"] += 1
                figures["turns"] += r["turns"] - (r["low"] is not None and r["low"] == figures["high"])
                figures["low"] = r["low"] if figures["low"] is None else figures["low"]
                figures["high"], last = r["until"]["turn"], r["last"]
            if done:
                yield pa.RecordBatch.from_pylist(done, types)
                done = []
        if seams:
            yield pa.RecordBatch.from_pylist(results(conv, cells, seams, figures), types)

    return rows.mapInArrow(run, COMPOSED_SCHEMA)


EDIT_SCHEMA = "conv_id long, place struct<turn:long,said:binary>, at int, key binary, role string, edit string"


def edits(parts: DataFrame, seams: DataFrame) -> DataFrame:
    """EDIT_SCHEMA: every turn of the repaired conversations in the order of (place, at): key of the row it was, or null if
    inserted; its new role, or null if kept."""
    on = F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")) & F.col("p.place.turn").eqNullSafe(F.col("s.place.turn")) & (F.col("p.place.said") == F.col("s.place.said"))
    audit = F.element_at("cells", 4 * F.col("before") + F.col("after") + 1)
    rows = parts.alias("p").join(seams.select("conv_id", "place", "before", "after").alias("s"), on).select("p.conv_id", "p.place", "keys", "ns", "initials", "before", audit.alias("audit"))
    types = _types(EDIT_SCHEMA)

    def walk(conv: int | None, place: dict, keys: list, ns: list, initials: str, state: int, audit: str) -> Iterator[tuple]:
        p = at = 0
        for key, n, initial in zip([None, *keys], [0, *ns], ["-", *initials], strict=True):
            if n and audit[p] != "D":
                state, at = dict(KEEP[state])[initial] if audit[p] == "K" else NEXT[state], at + 1
                yield conv, place, at, key, None if audit[p] == "K" else ROLES[state], audit[p]
            p += n
            while p < len(audit) and audit[p] == "I":
                state, p, at = NEXT[state], p + 1, at + 1
                yield conv, place, at, None, ROLES[state], "I"

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k in range(0, b.num_rows, 64):  # a chunk has up to CHUNK keys
                for r in zip(*(c.to_pylist() for c in b.slice(k, 64).columns), strict=True):
                    out += walk(*r)
                if len(out) > 20_000:
                    yield made(out)
                    out = []
            yield made(out)

    return rows.mapInArrow(run, EDIT_SCHEMA)


def repair(turns: DataFrame, most: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n, gaps, blank, duplicate, truncated, illegal, cost, audit) and their repaired turns (conv_id,
    place, at, edit, role, text; in the order of place and at) of turns (conv_id, turn, role, text)."""
    rows = common.materialize(narrow(turns), "narrow")
    parts = common.materialize(chunks(faults(rows), most), "chunks")
    composed = common.materialize(compose(parts), "composed")
    made = common.materialize(edits(parts, composed), "edits")
    texts = turns.select(*_keys(), F.col("role").alias("own"), "text").groupBy("key").agg(F.first("own").alias("own"), F.first("text").alias("text"))
    kept = made.filter("key is not null").join(texts, "key").select("conv_id", "place", "at", "edit", F.coalesce("role", "own").alias("role"), "text")
    new = made.filter("key is null").select("conv_id", "place", "at", "edit", "role", F.lit("").alias("text"))
    figures = composed.filter("last").select("conv_id", "n", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return figures, kept.unionByName(new)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and sha256 of each conversation's repaired turns, `role:text`, joined by newlines.

    A digest reads its message from start to end, so the turns of one conversation go through one task, as a stream."""
    import hashlib

    order = [F.col("conv_id").asc_nulls_first(), F.col("place.turn").asc_nulls_first(), "place.said", "at"]
    rows = repaired.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, running = None, None
        for b in batches:
            done = []
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if running is None or conv != of:
                    if running is not None:
                        done.append((of, running.hexdigest()))
                    of, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text.as_py()}".encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema)
        if running is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": of, "sha256": running.hexdigest()}], schema)

    return rows.mapInArrow(run, "conv_id long, sha256 string")
