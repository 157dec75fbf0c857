"""Resampling documents towards a target: hashed n-gram features whose checksums are composed, never spelled out.

1. A word's CRC-32 is computed once for each distinct word of a batch. Appending n bytes to a message multiplies
   its checksum by x^(8n), a linear map over GF(2): crc(a + " " + b) = shift(crc(a + " "), |b|) xor crc(b). Shifts by
   less than NEAR bytes are looked up by the four bytes of a checksum; longer ones go over the powers of two in the
   length, squared matrices. So runs of 1 to ORDER words need no string.
2. Features fall into BUCKETS buckets. Each task counts its own, Spark sums the counts (`histogram`).
3. A bucket's gain compares its share in the target with that in the corpus (`gains`); a document's weight is
   the sum over its features. The gains, BUCKETS numbers whatever the corpus, go to the tasks.
4. Scores add a Gumbel draw from a digest of the id, so that the highest scores are a sample without replacement in
   proportion to exp(weight). Ranks come from a sort by ranges and the sizes of the sorted parts (`ranked`).

Defined cases: null and wordless texts have no features, weight 0, and are not drawn; a null doc_id is an empty string in
its draw and comes after others of its score; rows that repeat a doc_id are documents of their own; equal scores go by
doc_id, then by the order of rows; words may have any length; an empty target or table gives a result; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vartide.llm import common

BUCKETS, ORDER, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
NEAR = 64
#: Bytes of one step over a batch, so that arrays stay small whatever the texts.
STEP = 1 << 22

_SPACE = np.uint32(zlib.crc32(b" "))
#: ASCII other than digits and letters parts words; A-Z in lower case.
_WORDS = bytes(b if b > 127 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _apply(tables: np.ndarray, crc: np.ndarray, base: np.ndarray | int = 0) -> np.ndarray:
    """The linear maps at `base` of flat tables (4 x 256 values each) on checksums."""
    out = tables[base + (crc & 255)]
    for k in (1, 2, 3):
        out = out ^ tables[base + 256 * k + ((crc >> np.uint32(8 * k)) & 255)]
    return out


def _tables(columns: np.ndarray) -> np.ndarray:
    """Tables of the map with these images of the 32 bits."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.concatenate([np.bitwise_xor.reduce(bits.astype(np.uint32) * columns[8 * k : 8 * k + 8], axis=1) for k in range(4)])


def _one_byte() -> np.ndarray:
    """Images of the 32 bits when a zero byte is appended (polynomial of zlib, reflected)."""
    c = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & 1, np.uint32(0xEDB88320), np.uint32(0))
    return c


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables for shifts by 0 to NEAR - 1 bytes, flat; and for NEAR, 2 NEAR, 4 NEAR... bytes."""
    one, c, near = _tables(_one_byte()), np.uint32(1) << np.arange(32, dtype=np.uint32), []
    for _ in range(NEAR):
        near.append(_tables(c))
        c = _apply(one, c)
    far = []
    for _ in range(40):
        t = _tables(c)
        far.append(t)
        c = _apply(t, c)
    return np.concatenate(near), far


_NEAR, _FAR = _shifts()


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums (uint32) after `length` more zero bytes, less what the bytes themselves add."""
    out = _apply(_NEAR, crc, (length % NEAR) * 1024)
    rest, k = length // NEAR, 0
    while rest.any():
        some = np.flatnonzero(rest & 1)
        out[some] = _apply(_FAR[k], out[some])
        rest, k = rest >> 1, k + 1
    return out


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in each text, bucket of each feature, and the text it belongs to."""
    index: dict[bytes, int] = {}
    words = [t.translate(_WORDS).split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    code = np.fromiter((index.setdefault(w, len(index)) for ws in words for w in ws), np.int64, int(n.sum()))
    crc, size = np.fromiter(map(zlib.crc32, index), np.uint32, len(index)), np.fromiter(map(len, index), np.int64, len(index))
    of = np.repeat(np.arange(len(words)), n)
    spaced = shift(crc, np.ones(len(crc), np.int64)) ^ _SPACE  # the word and a space
    last, lengths = crc[code], size[code]
    run, rows, docs = last, [last], [of]
    for k in range(1, ORDER):
        prefix = spaced[code[:-1]] if k == 1 else shift(run[:-1], np.ones(max(len(run) - 1, 0), np.int64)) ^ _SPACE
        run = shift(prefix, lengths[k:]) ^ last[k:]
        inside = of[k:] == of[: len(of) - k]
        rows.append(run[inside])
        docs.append(of[k:][inside])
    return n, np.concatenate(rows) % np.uint32(BUCKETS), np.concatenate(docs)


def _steps(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of a text column in steps of about STEP bytes: first row and texts."""
    start, held, size = 0, [], 0
    for text in column:
        held.append((text.as_py() or "").encode())
        size += len(held[-1])
        if size > STEP:
            yield start, held
            start, held, size = start + len(held), [], 0
    if held:
        yield start, held


def histogram(texts: DataFrame) -> DataFrame:
    """bucket and n (long) over all features of texts (text); buckets without features are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, step in _steps(b.column(0)):
                total += np.bincount(features(step)[1], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """bucket and gain (long) of every bucket, from two histograms."""
    s, t = (common.materialize(x, "histogram") for x in (corpus, target))
    all_s, all_t = (x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (s, t))
    every = s.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    both = every.join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    ratio = ((F.col("t") + 1.0) * F.lit(float(all_s + BUCKETS))) / ((F.col("s") + 1.0) * F.lit(float(all_t + BUCKETS)))
    return both.select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain"))


def weigh(docs: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features and weight (long) of every row of docs (doc_id, text)."""
    table = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, step in _steps(b.column(1)):
                words, bucket, of = features(step)
                n = np.bincount(of, minlength=len(step))
                weight = np.zeros(len(step), np.int64)
                np.add.at(weight, of, table[bucket])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(step)), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g) of the standard Gumbel draw g of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], most: Column) -> DataFrame:
    """rows with `rank`, 1, 2, 3... in that order, null where it exceeds `most`. The order must tell rows apart.

    Sorted by ranges, a row's rank is its place in its part and the sizes of the parts before it."""
    at = F.monotonically_increasing_id()  # of a written table: the part's number above 33 bits of places
    sorted_ = common.materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "sorted")
    part = F.shiftright("_at", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).sort("_part").collect()  # one row a part
    before, parts = 0, []
    for r in sizes:
        parts.append((r._part, before))
        before += r.n
    parts = rows.sparkSession.createDataFrame(parts, "_part long, _before long")
    rank = F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1
    out = sorted_.withColumn("_part", part).join(parts, "_part").withColumn("rank", rank)
    return out.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs (doc_id, text): the floor(percent * N / 100)
    highest scores of the N rows with enough words are drawn; target: text."""
    gain = gains(histogram(docs), histogram(target)).sort("bucket").collect()  # BUCKETS rows
    rows = weigh(docs, [r.gain for r in gain]).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    rows = common.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "weighed")
    enough = rows.filter(F.col("n_words") >= least_words)
    drawn = percent * enough.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    out = ranked(enough, order, F.lit(drawn)).unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.drop("row")
