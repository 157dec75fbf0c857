"""Deletion of repeated runs of lines, found by winnowing over line hashes.

1. A document is its sequence of non-blank lines (white space at either end does not count). Of every window
   of `min_lines` lines the least line hash is selected, the leftmost of equals. A position is kept once
   however many windows select it, and two documents that share a run of at least `min_lines` lines share a
   selected fingerprint inside it, with certainty. Lines of at least `min_words` words are selected too
   and are runs by themselves.
2. Fingerprints that stand at one position only are done; the positions of the others are joined.
3. A match is extended to both sides of the fingerprint: a position knows the content of the windows that
   selected it, up to `min_lines` - 1 lines before and after. One aggregation finds the first place (order:
   doc_id, then line) of each content around a fingerprint; positions meet that place only, never each other.
   Extensions that touch or overlap grow into one run of any length.
4. Runs that stand earlier elsewhere are deleted; the first stays.

Defined cases: null and empty texts have no lines and stay; rows that repeat doc_id and text count as
one document and get the same result; repeats inside a document count, too (the first place stays);
of equal places in the order (one doc_id with different texts) the text of the smaller hash is first; blank
lines inside a deleted run go with it; null doc_ids come first in the order; very long texts are taken whole,
their lines in one task; an empty table gives an empty result; other columns are passed through by
`delete_repeats` and never used, whatever their names; only one named `line_dedup` gives way to the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vartide.llm import common

POSITIONS = "doc_id long, text_key long, fingerprint long, line int, windows array<struct<before:int,size:int,content:bigint>>"
MIN_LINES, MIN_WORDS = 2, 50


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def lines_of(text: str | None) -> tuple[list[str], list[int]]:
    """(stripped non-blank lines, their numbers among all lines)."""
    found = [(x.strip(), k) for k, x in enumerate((text or "").split("\n"))]
    found = [x for x in found if x[0]]
    return [x for x, _ in found], [k for _, k in found]


def fingerprints(text: str | None, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(fingerprint, line, windows) of every selected line; windows that selected it: (lines before it, lines,
    hash of their content)."""
    lines, _ = lines_of(text)
    h = [_signed(xxhash.xxh64_intdigest(x)) for x in lines]
    selected: dict[int, list[tuple[int, int, int]]] = {}
    for k in range(len(h) - min_lines + 1):
        window = h[k : k + min_lines]
        at = k + window.index(min(window))
        selected.setdefault(at, []).append((at - k, min_lines, _signed(xxhash.xxh64_intdigest(np.array(window, "<i8").tobytes(), seed=min_lines))))
    for k, x in enumerate(lines):
        if len(x) > min_words and len(x.split()) >= min_words:
            selected.setdefault(k, []).append((0, 1, h[k]))
    return [(h[k], k, found) for k, found in selected.items()]


def positions(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """POSITIONS of all documents; text_key tells documents with one doc_id apart."""
    windows = pa.list_(pa.struct([("before", pa.int32()), ("size", pa.int32()), ("content", pa.int64())]))
    kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.int32()], ["doc_id", "text_key", "fingerprint", "line", "windows"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        *plain, found = zip(*rows, strict=True)
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        flat = np.array([x for ws in found for x in ws], np.int64).reshape(-1, 3)
        inner = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int64()).cast(pa.int32()), pa.array(flat[:, 1], pa.int64()).cast(pa.int32()), pa.array(flat[:, 2], pa.int64())], fields=list(windows.value_type))
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(plain, kinds, strict=True)), pa.ListArray.from_arrays(pa.array(ends), inner, type=windows)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, key in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("text_key").to_pylist(), strict=True):
                rows += [(doc_id, key, *x) for x in fingerprints(text.as_py(), min_lines, min_words)]
                if len(rows) > 100_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, POSITIONS)


def repeats(found: DataFrame) -> DataFrame:
    """doc_id, text_key and runs (arrays of line, size) of the windows that stand earlier elsewhere.
    found is read twice: give it a table."""
    place = F.struct("doc_id", "text_key", "line")
    several = found.groupBy("fingerprint").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).select("fingerprint")
    joined = found.join(common.materialize(several, "fingerprints"), "fingerprint")
    both = joined.select("fingerprint", "doc_id", "text_key", "line", F.explode("windows").alias("w")).select("fingerprint", "doc_id", "text_key", "line", "w.before", "w.size", "w.content")
    both = common.materialize(both, "extensions")
    key = ["fingerprint", "before", "size", "content"]
    firsts = both.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last")))
    firsts = common.materialize(firsts.select(*key, "first"), "firsts")
    later = both.join(firsts, key).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct((F.col("line") - F.col("before")).alias("line"), "size")).alias("runs"))


def delete_runs(text: str | None, runs: list[dict] | None) -> tuple[int, int, str]:
    """(lines, deleted lines, what is left of the text)."""
    lines, numbers = lines_of(text)
    if not runs:
        return len(lines), 0, text or ""
    gone = np.zeros(len(lines) + 1, np.int32)
    for r in runs:
        gone[r["line"]] += 1
        gone[r["line"] + r["size"]] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    drop, every = set(), (text or "").split("\n")
    for k in np.flatnonzero(gone):
        until = numbers[k + 1] if k + 1 < len(lines) and gone[k + 1] else numbers[k] + 1
        drop.update(range(numbers[k], until))
    return len(lines), int(gone.sum()), "\n".join(x for k, x in enumerate(every) if k not in drop)


def delete_repeats(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with `text` without later repeated runs, and a struct `line_dedup` (n_lines, n_removed, sha256)."""
    found = common.materialize(positions(docs, min_lines, min_words), "lines")
    names = [c for c in docs.columns if c.lower() != "line_dedup"]
    doc, key, runs = (common.unused(x, docs.columns) for x in ("doc", "key", "runs"))
    gone = repeats(found).select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("runs").alias(runs))
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("n_lines", pa.int64()), ("n_removed", pa.int64()), ("sha256", pa.string())])
        for b in batches:
            texts, facts = [], []
            for text, found in zip(b.column("text"), b.column(runs), strict=True):
                n, gone, left = delete_runs(text.as_py(), found.as_py())
                texts.append(left if text.is_valid else None)
                facts.append({"n_lines": n, "n_removed": gone, "sha256": hashlib.sha256(left.encode()).hexdigest()})
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(facts, kind)], [*names, "line_dedup"])

    schema = docs.select(*names, F.lit(None).cast("struct<n_lines:bigint,n_removed:bigint,sha256:string>").alias("line_dedup")).schema
    return joined.select(*names, runs).mapInArrow(run, schema)
