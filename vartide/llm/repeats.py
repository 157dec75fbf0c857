"""Maximal repeats of byte strings across a corpus, by enhanced suffix arrays over shared anchors.

1. Anchors. Of every `min_len`-byte window the least hash of its k-byte grams is selected (leftmost of
   equals). The choice depends on the window's bytes alone, so equal windows have equal anchors at equal
   offsets, and consecutive windows with one anchor form a region around it.
2. Bins. Suffixes that start at anchors and share a gram share a prefix: the gram's hash is the bin. Bins
   with one region are done; regions with equal bytes are one class with all its places.
3. In each remaining bin the anchor suffixes of its classes are sorted, their common prefixes give the
   interval tree (one scan with a stack), and every interval is tested for left-extension diversity by the
   same scan over its members' reversed left sides: each pair of nodes whose lengths add up to `min_len`
   is a maximal repeat group with all its occurrences.
4. A bin of more than BIN classes is too large for one task: its windows are told apart by their whole
   content instead, with partial counts, which gives the same reach for each class.

Places within a region are exact; a repeat longer than its regions appears as overlapping groups.
Nothing is collected: bins, classes and places are tables; texts are joined by (doc_id, text hash).

Defined cases: null text is empty; texts shorter than min_len have no repeats; very long texts are hashed STEP bytes
at a time and otherwise taken whole; of equal hashes in a window the leftmost is the anchor; a row that repeats
another is another place of the same bytes; null doc_ids are kept (joined null-safe); extra columns
are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vartide.llm import common

MIN_LEN, GRAM, BIN = 200, 48, 4096
#: Windows hashed at a time; positions of one step fit the low bits of a packed key.
STEP, BITS = 1 << 20, 21
PLACES = "gram long, region long, doc_id long, text_key long, at int, start int, stop int"

_TABLE = np.random.default_rng(30).integers(0, 1 << 64, 256, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _ODD and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size, inverse = max(n, 1 << 14), np.uint64(pow(int(_ODD), -1, 1 << 64))
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))]) for x in (_ODD, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every `width` neighbours, from running minima of blocks to both sides."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, min_len: int = MIN_LEN, k: int = GRAM) -> list[np.ndarray]:
    """Per region of one document's bytes: gram, region (hashes), at, start, stop."""
    found = []
    for low in range(0, len(data) - min_len + 1, STEP):
        windows = min(STEP, len(data) - min_len + 1 - low)
        b = data[low : low + windows + min_len - 1]
        up, down = _powers(len(b) + 1)
        prefix = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_TABLE[b] * up[:-1], out=prefix[1:])
        grams = _mixed((prefix[k:] - prefix[:-k]) * down[: len(b) - k + 1])
        mask = np.uint64((1 << BITS) - 1)
        keys = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        at = (sliding_least(keys, min_len - k + 1) & mask).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        stop = np.concatenate([first[1:], [windows]]) - 1 + min_len
        at = at[first]
        shape = ((at - first) * 1024 + stop - first).astype(np.uint64)
        region = _mixed((prefix[stop] - prefix[first]) * down[first] + shape * np.uint64(0xC2B2AE3D27D4EB4F))
        found.append((grams[at], region, at + low, first + low, stop + low))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else []


def places(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """PLACES of docs (doc_id, text_key, text)."""
    names = [x.split()[0] for x in PLACES.split(", ")]

    def batch(b: pa.RecordBatch, held: list[tuple[int, list[np.ndarray]]]) -> pa.RecordBatch:
        of = pa.array(np.repeat([k for k, _ in held], [len(x[0]) for _, x in held]))
        gram, region, *rest = (np.concatenate(x) for x in zip(*(x for _, x in held), strict=True))
        cols = [pa.array(gram.view(np.int64)), pa.array(region.view(np.int64)), b.column("doc_id").take(of), b.column("text_key").take(of)]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array(x.astype(np.int32)) for x in rest)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for i, text in enumerate(b.column("text")):
                raw = (text.as_py() or "").encode()
                if len(raw) >= min_len:
                    held.append((i, anchors(np.frombuffer(raw, np.uint8), min_len)))
                    size += len(held[-1][1][0])
                if size > 200_000:
                    yield batch(b, held)
                    held, size = [], 0
            if held:
                yield batch(b, held)

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, PLACES)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1  # a[:low] is common, a[:high + 1] is not
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """The interval tree of a suffix array by one scan with a stack: (common prefix, first, last) of every
    node, lcp[i] being the common prefix of suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []  # (value, first suffix)
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > value:
            depth, first = stack.pop()
            yield depth, first, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def repeats_in_bin(lefts: list[bytes], rights: list[bytes], min_len: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeat groups around one anchor: (bytes left of it, bytes from it on, members).

    lefts end where the anchor starts, rights start there. A node of the suffix tree of the rights fixes how
    far its members agree to the right; the nodes of its members' reversed lefts are where left extensions
    become diverse. A group whose members all lie in one child is reported there, further to the right."""
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    backwards = [x[::-1] for x in lefts]
    most_left = max(map(len, lefts))
    for right, first, last in intervals(lcp):
        if right + most_left < min_len:
            continue
        members = sorted(range(first, last + 1), key=lambda i: backwards[order[i]])
        lcs = [common_prefix(backwards[order[a]], backwards[order[b]]) for a, b in zip(members, members[1:], strict=False)]
        for left, low, high in intervals(lcs):
            if left + right < min_len:
                continue
            group = members[low : high + 1]
            if min(lcp[min(group) : max(group)]) == right:
                yield left, right, [order[i] for i in group]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes], list[bytes]]]:
    """Bins (gram, regions, lefts, rights) of batches sorted by gram."""
    of, held = None, ([], [], [])
    for b in batches:
        for gram, region, left, right in zip(*(b.column(c).to_pylist() for c in ("gram", "region", "left", "right")), strict=True):
            if gram != of:
                if len(held[0]) > 1:
                    yield (of, *held)
                of, held = gram, ([], [], [])
            for x, y in zip(held, (region, left, right), strict=True):
                x.append(y)
    if len(held[0]) > 1:
        yield (of, *held)


def bin_groups(sliced: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """gram, group, region, reach_left, reach_right: every class of every maximal repeat group of the bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names, types = ["gram", "group", "region", "reach_left", "reach_right"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        for gram, regions, lefts, rights in _grouped(batches):
            for k, (left, right, members) in enumerate(repeats_in_bin(lefts, rights, min_len)):
                rows += [(gram, k, regions[i], left, right) for i in members]
            if len(rows) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    dealt = sliced.select("gram", "region", "left", "right").repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "gram long, group int, region long, reach_left int, reach_right int")


def bin_reaches(sliced: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """gram, region, reach_left, reach_right: the farthest reach of each class over its groups in the bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names, types = ["gram", "region", "reach_left", "reach_right"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        for gram, regions, lefts, rights in _grouped(batches):
            far: dict[int, tuple[int, int]] = {}
            for left, right, members in repeats_in_bin(lefts, rights, min_len):
                for i in members:
                    a, b = far.get(i, (0, 0))
                    far[i] = (max(a, left), max(b, right))
            rows += [(gram, regions[i], a, b) for i, (a, b) in far.items()]
            if len(rows) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    dealt = sliced.select("gram", "region", "left", "right").repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "gram long, region long, reach_left int, reach_right int")


def window_rows(sliced: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """gram, region, window (hash of its bytes), ahead (its bytes before the anchor) of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for gram, region, left, right in zip(*(b.column(c).to_pylist() for c in ("gram", "region", "left", "right")), strict=True):
                data = left + right
                h = [xxhash.xxh64_intdigest(data[i : i + min_len]) for i in range(len(data) - min_len + 1)]
                n = len(h)
                cols = [pa.array(np.full(n, gram)), pa.array(np.full(n, region)), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(len(left) - np.arange(n, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["gram", "region", "window", "ahead"])

    return sliced.mapInArrow(run, "gram long, region long, window long, ahead int")


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def slice_classes(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """gram, region, hot, left, right: the bytes of each class's first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["gram", "region", "hot", "left", "right"], [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        for b in batches:
            for text, found in zip(b.column("text"), b.column("found"), strict=True):
                raw = (text.as_py() or "").encode()
                rows = [(r["gram"], r["region"], r["hot"], raw[r["start"] : r["at"]], raw[r["at"] : r["stop"]]) for r in found.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    by_doc = classes.groupBy("place.doc_id", "place.text_key").agg(F.collect_list(F.struct("gram", "region", "hot", "place.at", "place.start", "place.stop")).alias("found"))
    joined = docs.join(by_doc, _same_doc(docs, by_doc)).select("text", "found")
    return joined.mapInArrow(run, "gram long, region long, hot boolean, left binary, right binary").dropDuplicates(["gram", "region"])


def shared_places(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """The places whose gram stands elsewhere, too: PLACES and `mixed`, whether its regions differ."""
    every = common.materialize(places(docs, min_len), "places")
    grams = every.groupBy("gram").agg(F.count("*").alias("n"), F.min("region").alias("low"), F.max("region").alias("high")).filter("n > 1")
    grams = common.materialize(grams.select("gram", (F.col("low") != F.col("high")).alias("mixed")), "grams")
    common.release(docs.sparkSession)
    shared = common.materialize(every.join(grams, "gram"), "shared")
    common.discard(every)  # most places are alone and of no more use
    return shared


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def reaches(shared: DataFrame, docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """gram, region, reach_left, reach_right: how far repeats reach around the anchor of each class."""
    place = F.struct("doc_id", "text_key", "at", "start", "stop")
    classes = shared.filter("mixed").groupBy("gram", "region").agg(F.count("*").alias("n"), F.min(place).alias("place"))
    classes = common.materialize(classes, "classes")
    bins = common.materialize(classes.groupBy("gram").agg((F.count("*") > BIN).alias("hot")), "bins")
    sliced = common.materialize(slice_classes(classes.join(bins, "gram"), docs), "sliced")
    whole = classes.filter("n > 1").select("gram", "region", (F.col("place.at") - F.col("place.start")).alias("reach_left"), (F.col("place.stop") - F.col("place.at")).alias("reach_right"))
    from_bins = bin_reaches(sliced.filter("not hot"), min_len)
    windows = common.materialize(window_rows(sliced.filter("hot"), min_len), "windows")
    twice = common.materialize(windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window"), "twice")
    from_windows = windows.join(twice, "window").select("gram", "region", F.col("ahead").alias("reach_left"), (F.lit(min_len) - F.col("ahead")).alias("reach_right"))
    found = whole.unionByName(from_bins).unionByName(from_windows)
    return common.materialize(found.groupBy("gram", "region").agg(F.max("reach_left").alias("reach_left"), F.max("reach_right").alias("reach_right")), "reaches")


def repeat_groups(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """Maximal repeat groups with all occurrences: group_id, length, doc_id, text_key, start. In a bin of more
    than BIN classes the groups are its repeated `min_len`-byte windows, found with partial counts."""
    docs = keyed(docs)
    shared = shared_places(docs, min_len)
    place = F.struct("doc_id", "text_key", "at", "start", "stop")
    classes = common.materialize(shared.groupBy("gram", "region").agg(F.count("*").alias("n"), F.min(place).alias("place")), "classes")
    mixed = shared.filter("mixed").select("gram").distinct()
    bins = common.materialize(classes.join(mixed, "gram").groupBy("gram").agg((F.count("*") > BIN).alias("hot")), "bins")
    sliced = common.materialize(slice_classes(classes.join(bins, "gram"), docs), "sliced")
    groups = bin_groups(sliced.filter("not hot"), min_len).select("gram", F.xxhash64("gram", "group").alias("group_id"), "region", "reach_left", "reach_right")
    windows = common.materialize(window_rows(sliced.filter("hot"), min_len), "windows")
    twice = common.materialize(windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window"), "twice")
    from_windows = windows.join(twice, "window").select("gram", F.col("window").alias("group_id"), "region", F.col("ahead").alias("reach_left"), (F.lit(min_len) - F.col("ahead")).alias("reach_right"))
    same = classes.filter("n > 1").select("gram", F.xxhash64("gram", "region").alias("group_id"), "region", (F.col("place.at") - F.col("place.start")).alias("reach_left"), (F.col("place.stop") - F.col("place.at")).alias("reach_right"))
    every = shared.join(groups.unionByName(from_windows).unionByName(same), ["gram", "region"])
    return every.select("group_id", (F.col("reach_left") + F.col("reach_right")).alias("length"), "doc_id", "text_key", (F.col("at") - F.col("reach_left")).alias("start"))


def remove_spans(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(removed bytes, maximal removed runs, what is left) for spans that may overlap."""
    kept, removed, runs, end = [], 0, 0, -1
    last = 0
    for a, b in sorted(spans):
        if a > end:
            runs += 1
            kept.append(raw[last:a])
            removed += b - a
            end = last = b
        elif b > end:
            removed += b - end
            end = last = b
    kept.append(raw[last:])
    return removed, runs, b"".join(kept)


def remove_repeats(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256 of every row."""
    docs = keyed(docs)
    shared = shared_places(docs, min_len)
    common.release(docs.sparkSession)
    reach = reaches(shared, docs, min_len)
    common.release(docs.sparkSession)
    spans = shared.filter("not mixed").select("doc_id", "text_key", "start", "stop")
    mixed = shared.filter("mixed").join(reach, ["gram", "region"])
    spans = spans.unionByName(mixed.select("doc_id", "text_key", (F.col("at") - F.col("reach_left")).alias("start"), (F.col("at") + F.col("reach_right")).alias("stop")))
    by_doc = spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = docs.join(by_doc, _same_doc(docs, by_doc), "left").select(docs["doc_id"], "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
                raw = (text.as_py() or "").encode()
                rows.append((len(raw), *remove_spans(raw, [(s["start"], s["stop"]) for s in spans.as_py() or []])))
            n, removed, runs, kept = list(zip(*rows, strict=True)) or [[]] * 4
            cols = [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
