"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Best-fit decreasing needs of a piece only its length, so the histogram of piece lengths (at most
`capacity` rows at any input size) is packed on the driver: lengths from long to short, each into the
fullest bins that still take it, found by a segment tree over remaining capacities in logarithmic
time. Equal pieces and equal bins move in runs, so the plan has few rows however many pieces there
are, and it places exactly what document-by-document best-fit decreasing would. Tasks then look up
each piece's place by its length and its rank among pieces of that length. Ranks come from buckets
of hashed documents, so a length that a third of all pieces share is ranked by many tasks.

Defined cases: null and empty texts are the end token alone; repeated rows are packed as often as they
come; ties (equal lengths) are ranked by doc_id, piece and checksum; very long texts are encoded whole, in one
task; an empty table packs nothing; extra columns, whatever their names, are ignored. Only documents over `capacity` tokens are cut: full pieces from the end,
what is left comes first.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vartide.llm import common

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes: printable Latin-1 stands
    for itself, the remaining bytes follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def load_encoding(path: str, pattern: str):
    """The byte-level BPE of a tokenizers file as a tiktoken encoding: the same ids, several times faster
    (tests hold both against each other). Added tokens are met in texts as their ids; those with options
    that tiktoken does not know are refused."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], file.get("added_tokens") or []
    if odd := [t["content"] for t in added if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]:
        raise ValueError(f"added tokens with options that are not supported: {odd}")
    alphabet, special = byte_alphabet(), {t["content"]: t["id"] for t in added}
    ranks = {bytes(alphabet[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def tokenize(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 1024, end_token: int = 2) -> DataFrame:
    """PIECE_SCHEMA rows of every document's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(tokenizer_path, pattern)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.array([*encoding.encode(text.as_py() or "", allowed_special="all"), end_token], "<u4")
                n, at, piece = len(ids), 0, 0
                while at < n:
                    size = min(capacity, (n - at - 1) % capacity + 1) if piece == 0 else capacity
                    rows.append((doc_id, piece, at, size, zlib.crc32(ids[at : at + size].tobytes())))
                    at, piece = at + size, piece + 1
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in PIECE_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE_SCHEMA)


class CapacityTree:
    """Segment tree over remaining capacities 0..n: the smallest capacity >= x that some open bin has."""

    def __init__(self, n: int):
        self.size = 1 << (n + 1).bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        at = capacity + self.size
        while at:
            self.open[at] += bins
            at //= 2

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        while not self.open[at]:  # up to the first subtree to the right that holds a bin
            while at & 1:
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on counts. Rows (length, first rank, pieces, first bin, offset, per bin):
    piece `rank` goes to bin first + (rank - first rank) // per, at offset + length * ((rank - first rank) % per)."""
    tree, runs, bins, out = CapacityTree(capacity), {}, 0, []  # runs: capacity -> [(first bin, bins)]
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, need = capacity, -(-left // (capacity // length))
                first, bins = bins, bins + need
                runs.setdefault(room, []).append((first, need))
                tree.add(room, need)
            first, n = runs[room].pop()
            tree.add(room, -n)
            per = room // length
            full = min(n, left // per)
            for used, size in ((full, per), (1 if full < n and 0 < left - full * per < per else 0, left - full * per)):
                if not used:
                    continue
                out.append((length, rank, used * size, first, capacity - room, size))
                after = room - size * length
                runs.setdefault(after, []).append((first, used))
                tree.add(after, used)
                first, n, rank, left = first + used, n - used, rank + used * size, left - used * size
            if n:
                runs[room].append((first, n))
                tree.add(room, n)
    return out


def rank_within(pieces: DataFrame, buckets: int) -> DataFrame:
    """Add rank (from 0) among the pieces of a length, in the order of hashed buckets."""
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    base = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    return keyed.withColumn("within", within - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("within"))


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces (lengths 1..capacity) with sequence_id and offset; reads its input twice, so give it a table."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # at most `capacity` rows
    plan = plan_bins(histogram, capacity)
    starts: dict[int, list[int]] = {}
    rows: dict[int, list[tuple]] = {}
    for row in plan:
        starts.setdefault(row[0], []).append(row[1])
        rows.setdefault(row[0], []).append(row[2:])
    ranked = rank_within(pieces, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shared = spark.sparkContext.broadcast((starts, rows))  # as many rows as lengths allow, at any input size

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, rows = shared.value
        for b in batches:
            sequence, offset = [], []
            for length, rank in zip(b.column("length").to_pylist(), b.column("rank").to_pylist(), strict=True):
                k = bisect_left(starts[length], rank + 1) - 1
                i, (_, first, at, per) = rank - starts[length][k], rows[length][k]
                sequence.append(first + i // per)
                offset.append(at + length * (i % per))
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 1024, end_token: int = 2) -> DataFrame:
    return pack(common.materialize(tokenize(docs, tokenizer_path, pattern, capacity, end_token), "pieces"), capacity)
