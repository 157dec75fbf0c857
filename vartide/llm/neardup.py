"""Near duplicates by SetSketch registers: band, estimate jointly by likelihood, verify.

1. Every document becomes its set of distinct 5-word shingles (64-bit hashes) and a sketch: for each of
   REGISTERS hash functions the least exponential value of the set, rounded to powers of BASE and
   truncated to LIMIT. Registers of a union are the maxima of its parts' registers (`merge`).
2. Documents with equal sets form a class, represented by its smallest doc_id; only representatives
   go on. Registers are banded; representatives that share a band's value meet in a bucket.
3. In each bucket every member is paired with the smallest one only. Pairs whose likelihood over the
   three outcomes of registers (greater, equal, less), given both set sizes, peaks too far below the
   threshold are dropped, the rest is verified on full sets, and components are formed.
4. A bucket whose other members still span several components may hide links between these. Members that share
   shingles with too few others to reach the threshold are out. The rest falls into clusters of overlapping
   buckets, and each member becomes its difference from what most of its cluster holds (`deviations`). Sizes of
   intersections follow exactly from the differences, which are short where a cluster is dense: the text that all
   members have no longer makes pairs.
5. Members so close to the least deviating one that no difference in common is needed are linked to it. For any other link a
   number of differences in common follows from both sizes; a pair that has them shares one of each side's first
   few, rarest first (`joined`). Who shares one meets in blocks of at most BLOCK members, which are compared on their whole
   differences; each block gives at most one link a member, those that join its components.

Steps 3 and 5 give as many pairs as a bucket or block has members; step 5 is exact for what step 3 leaves: every link
between members that share a bucket is found, and nothing is capped.

A pair at similarity .85 misses all 25 bands of 5 registers with probability 5e-7. At lower thresholds
bands have fewer registers (`band_width`): at .80, 31 bands of 4 miss a pair with probability 8e-8.

Defined cases: documents without words or text have the empty set and stay alone, as do null doc_ids
(component null); rows that repeat a doc_id are one document as far as links go and each get a result;
with fewer than five words the whole sequence is one shingle; equal sets always link, and of members that tie for
smallest, rarest or least deviating the smallest id or hash goes first; very long texts are
taken whole; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vartide.llm import common, graph

WORDS, REGISTERS, ROWS = 5, 125, 5
BASE, LIMIT = 1.02, 1200
SKETCH_SCHEMA = "doc_id long, n_shingles long, set_key binary, registers binary"
#: Members of a block of step 5, and differences that they have together.
BLOCK, BLOCK_SIZE = 1024, 1 << 20
#: Ids (8 bytes each) that are sent to all tasks; more are joined by a shuffle of the texts.
FEW_MEMBERS = 2_000_000
#: The same for rows of pairs (a, salt, node, role).
FEW_NODES = 500_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = np.random.default_rng(20).integers(1 << 62, 1 << 63, WORDS, np.uint64) | np.uint64(1)
_MULTIPLIERS = np.random.default_rng(21).integers(1 << 30, 1 << 32, REGISTERS, np.uint64).astype(np.uint32) | np.uint32(1)
_OFFSETS = np.random.default_rng(22).integers(0, 1 << 32, REGISTERS, np.uint64).astype(np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = (text or "").encode().translate(_LOWER).split()  # bytes.split parts at exactly 0x20 and 0x09-0x0D
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    if len(h) < WORDS:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=len(h))], np.uint64) if len(h) else h
    n = len(h) - WORDS + 1
    s = h[:n] * _MIX[0]
    for j in range(1, WORDS):
        s = (s ^ (s >> np.uint64(29))) * _MIX[0] + h[j : n + j] * _MIX[j]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(s ^ (s >> np.uint64(29)))


def sketch(shingle_set: np.ndarray) -> np.ndarray:
    """REGISTERS exponentially spaced truncated minima (int16); an empty set gives zeros."""
    if not len(shingle_set):
        return np.zeros(REGISTERS, np.int16)
    x, least = (shingle_set >> np.uint64(32)).astype(np.uint32), np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):  # long texts in steps that stay in the cache
        np.minimum(least, ((x[k : k + 2048, None] ^ _OFFSETS) * _MULTIPLIERS).min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT).astype(np.int16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_width(percent: int) -> int:
    """The most registers a band may have, up to ROWS, so that a pair at the threshold misses all bands with
    probability below 1e-6."""
    return next((w for w in range(ROWS, 1, -1) if (1 - (percent / 100) ** w) ** (REGISTERS // w) < 1e-6), 1)


def bands(registers: np.ndarray, width: int = ROWS) -> list[int]:
    """One signed 64-bit key for each full band of `width` registers."""
    raw = registers.tobytes()
    size = 2 * width
    keys = (xxhash.xxh64_intdigest(raw[k : k + size], seed=k) for k in range(0, len(raw) - size + 1, size))
    return [x - (1 << 64) if x >> 63 else x for x in keys]


_GRID = np.linspace(0.0, 1.0, 101)


def likely_similarity(greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity from counts of registers of a above, and below, those of b.

    With shares u and v of the set sizes, a register of a is above that of b with probability
    p(u - vJ), below with p(v - uJ), where p(x) = -log_b(1 - x (b - 1) / b)."""
    u = (n_a / (n_a + n_b))[:, None]
    v, j = 1 - u, np.minimum(_GRID[None, :], np.minimum(u / (1 - u), (1 - u) / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    above, below = np.clip(p(u - v * j), 1e-9, 1), np.clip(p(v - u * j), 1e-9, 1)
    equal = np.clip(1 - above - below, 1e-9, 1)
    fit = greater[:, None] * np.log(above) + less[:, None] * np.log(below) + (REGISTERS - greater - less)[:, None] * np.log(equal)
    return np.take_along_axis(j, fit.argmax(axis=1)[:, None], 1)[:, 0]


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def sketches(docs: DataFrame) -> DataFrame:
    """SKETCH_SCHEMA; set_key (128 bits) is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(text.as_py())
                rows.append((doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, sketch(s).tobytes()))
            yield _batch(rows, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["doc_id", "n_shingles", "set_key", "registers"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SKETCH_SCHEMA)


def band_rows(classes: DataFrame, width: int = ROWS) -> DataFrame:
    """band, rep for every band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps = np.repeat(b.column(0).to_numpy(), REGISTERS // width)
            keys = [k for r in b.column(1) for k in bands(np.frombuffer(r.as_py(), np.int16), width)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(reps, pa.int64())], ["band", "rep"])

    return classes.select("rep", "registers").mapInArrow(run, "band long, rep long")


def likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) those whose likelihood peaks at `least` or above."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.int16).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
            j = likely_similarity((x > y).sum(1), (x < y).sum(1), b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
            keep = pa.array(j >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, docs: DataFrame, percent: int, salts: int = 64) -> DataFrame:
    """Of distinct pairs (a, b) those with 100 * intersection >= percent * union of their full sets.

    b's text goes to a's, dealt over `salts` groups for each a; a group is read as a stream."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    nodes = dealt.select("a", "salt", F.col("b").alias("node"), F.lit(1).alias("role")).unionByName(dealt.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("node"), F.lit(0).alias("role")))
    nodes = common.materialize(nodes, "nodes")
    few = nodes.count() <= FEW_NODES  # then only the texts of pairs move
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    rows = texts.join(F.broadcast(nodes) if few else nodes, "node").repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "node").select("a", "salt", "role", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, mine = None, None
        for b in batches:
            out = []
            for a, salt, role, node, text in zip(*(b.column(c).to_pylist() for c in ("a", "salt", "role", "node")), b.column("text"), strict=True):
                s = shingles(text.as_py())
                if role == 0:
                    mine = [*mine, s] if of == (a, salt) else [s]
                    of = (a, salt)
                    continue
                for m in mine:
                    both = len(np.intersect1d(m, s, assume_unique=True))
                    if both and 100 * both >= percent * (len(m) + len(s) - both):
                        out.append((a, node))
                        break
            yield _batch(out, [pa.int64()] * 2, ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def shingle_rows(members: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, shingle for every shingle of the members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rep, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(text.as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), rep)), pa.array(s)], ["rep", "shingle"])

    members = common.materialize(members, "asked")
    few = members.count() <= FEW_MEMBERS  # then texts stay where they are until their readers are found
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(F.broadcast(members) if few else members, "rep").dropDuplicates(["rep"])
    return texts.select("rep", "text").mapInArrow(run, "rep long, shingle long")


def across(buckets: DataFrame) -> DataFrame:
    """The rows of buckets (band, label, ...) that span several labels."""
    mixed = buckets.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band")
    return buckets.join(common.materialize(mixed, "mixed"), "band")


def deviations(held: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """rep, cluster, label, weight, off: each member's difference (sorted hashes) from what most of its cluster holds.

    held: rep, shingle of members with others; members: rep, cluster, label, n_shingles. With n the set's size and d the
    difference's, two members link if and only if they share at least (weight + weight') / (2 (100 + percent)) of their
    differences, where weight = 2 percent n - (100 + percent) (held - d)."""
    few = members.count() <= FEW_MEMBERS
    clusters = members.select("rep", "cluster")
    rows = common.materialize(held.select("rep", "shingle").join(F.broadcast(clusters) if few else clusters, "rep"), "held")
    size = rows.select("cluster", "rep").distinct().groupBy("cluster").agg(F.count("*").alias("m"))
    most = rows.groupBy("cluster", "shingle").agg(F.count("*").alias("k")).join(size, "cluster").filter(2 * F.col("k") > F.col("m"))
    usual = common.materialize(most.groupBy("cluster").agg(F.collect_set("shingle").alias("usual")), "usual")  # at most twice a mean set
    own = common.materialize(rows.groupBy("rep").agg(F.collect_list("shingle").alias("own")), "own")
    both = common.materialize(members.join(own, "rep"), "members").join(usual, "cluster", "left").withColumn("usual", F.coalesce("usual", F.array().cast("array<bigint>")))
    off = F.array_sort(F.concat(F.array_except("own", "usual"), F.array_except("usual", "own")))
    both = both.withColumn("off", off)
    weight = 2 * percent * F.col("n_shingles") - (100 + percent) * (F.size("own") - F.size("off"))
    return both.select("rep", "cluster", "label", weight.cast("long").alias("weight"), "off")


def spanning(weights: np.ndarray, offs: list[np.ndarray], labels: np.ndarray, sides: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Of members the fewest pairs (places) that link and join all components that links join, across labels; with
    sides only links from one side to the other count."""
    flat = np.concatenate(offs)
    shingle, code = np.unique(flat, return_inverse=True)
    of = np.repeat(np.arange(len(offs)), [len(o) for o in offs])
    root = {x: x for x in labels.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, order = [], np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(shingle) + 1))
    for a in range(len(offs)):
        mine = code[of == a] if len(offs) < 64 else code[np.searchsorted(of, a) : np.searchsorted(of, a + 1)]
        holders = np.concatenate([order[starts[c] : starts[c + 1]] for c in mine]) if len(mine) else order[:0]
        shared = np.bincount(of[holders], minlength=len(offs))
        linked = 2 * (100 + percent) * shared >= weights[a] + weights
        linked &= labels != labels[a]
        linked[: a + 1] = False
        if sides is not None:
            linked &= sides != sides[a]
        for b in np.flatnonzero(linked).tolist():
            x, y = find(int(labels[a])), find(int(labels[b]))
            if x != y:
                root[x] = y
                out.append((a, b))
    return out


def joined(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that link, enough of them to join all components that links within clusters join; members as
    `deviations` gives them. A pair that links shares one of each side's first differences, rarest first."""
    least = common.materialize(members.groupBy("cluster").agg(F.min(F.struct("weight", "rep", "label")).alias("least")), "least")
    rows = common.materialize(members.join(least, "cluster"), "weighed")
    near = (F.col("weight") + F.col("least.weight") <= 0) & (F.col("label") != F.col("least.label"))
    close = rows.filter(near).select(F.least("rep", "least.rep").alias("a"), F.greatest("rep", "least.rep").alias("b"))

    unit = 2 * (100 + percent)
    need = F.greatest(F.lit(1), F.ceil((F.col("weight") + F.col("least.weight")) / unit))
    rows = rows.withColumn("first", F.size("off") - need + 1).filter("first > 0").select("rep", "cluster", "label", "weight", "off", "first")
    each = rows.select("cluster", "rep", "first", F.explode("off").alias("shingle"))
    rare = each.groupBy("cluster", "shingle").agg(F.count("*").alias("holders")).filter("holders > 1")
    own = F.row_number().over(Window.partitionBy("rep").orderBy("holders", "shingle"))
    alone = F.col("size") - F.count("*").over(Window.partitionBy("rep"))  # differences that nobody shares come first
    shared = common.materialize(each.join(rare, ["cluster", "shingle"]).join(rows.select("rep", F.size("off").alias("size")), "rep"), "shared")
    firsts = shared.withColumn("at", own + alone).filter("at <= first").select("cluster", "shingle", "rep")
    firsts = common.materialize(firsts.join(rows.select("rep", "label", "weight", "off"), "rep"), "firsts")
    sizes = firsts.groupBy("cluster", "shingle").agg(F.count("*").alias("k"), F.sum(F.size("off")).alias("all"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("all") / BLOCK_SIZE)).cast("int")
    sizes = common.materialize(sizes.select("cluster", "shingle", blocks.alias("blocks")), "sizes")
    cells = firsts.join(sizes, ["cluster", "shingle"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    cells = cells.select("cluster", "shingle", F.explode(to).alias("cell"), "rep", "label", "weight", "block", "off").select("cluster", "shingle", "cell.i", "cell.j", "rep", "label", "weight", "block", "off")
    cells = cells.repartition("cluster", "shingle", "i", "j").sortWithinPartitions("cluster", "shingle", "i", "j", "rep")

    def pairs_of(cell: tuple, held: list[tuple]) -> list[tuple[int, int]]:
        rep, label, weight, block = (np.array(c, np.int64) for c in list(zip(*held, strict=True))[:4])
        pairs = spanning(weight, [h[4] for h in held], label, block if cell[2] != cell[3] else None, percent)
        return [(int(min(rep[a], rep[b])), int(max(rep[a], rep[b]))) for a, b in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []
        for b in batches:
            out = []
            keys = zip(*(c.to_pylist() for c in b.columns[:4]), strict=True)
            facts = zip(*(c.to_pylist() for c in b.columns[4:8]), strict=True)
            for cell, fact, off in zip(keys, facts, b.column(8), strict=True):
                if cell != of:
                    out += pairs_of(of, held) if len(held) > 1 else []
                    of, held = cell, []
                held.append((*fact, off.values.to_numpy()))
            yield _batch(out, [pa.int64()] * 2, ["a", "b"])
        if len(held) > 1:
            yield _batch(pairs_of(of, held), [pa.int64()] * 2, ["a", "b"])

    found = cells.mapInArrow(run, "a long, b long")
    return close.unionByName(found).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    width, least = band_width(percent), percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5
    sk = common.materialize(sketches(docs), "sketches")
    some = sk.filter("n_shingles > 0 and doc_id is not null")
    classes = common.materialize(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")), "classes")
    buckets = common.materialize(band_rows(classes, width).groupBy("band").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader <> last").select("band", "leader"), "buckets")
    met = common.materialize(band_rows(classes, width).join(buckets, "band"), "met")
    star = common.materialize(met.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "star")
    links = common.materialize(verify(likely(star, classes, least), docs, percent), "links")
    labels = graph.components(links)
    named = lambda rows: rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))

    # the smallest member has met all others, so only links between others can be hidden
    others = named(met.filter("rep <> leader")).select("band", "rep", "label")
    open_ = common.materialize(across(common.materialize(others, "labelled")), "open")
    shingled = common.materialize(shingle_rows(open_.select("rep").distinct(), docs), "shingles")
    several = shingled.groupBy("shingle").agg(F.count("*").alias("holders")).filter("holders > 1")
    held = common.materialize(shingled.join(several, "shingle"), "held")
    common.discard(shingled)
    facts = held.groupBy("rep").agg(F.count("*").alias("shared")).join(classes.select("rep", "n_shingles"), "rep")
    facts = common.materialize(facts.filter(100 * F.col("shared") >= percent * F.col("n_shingles")).select("rep", "n_shingles"), "facts")
    open_ = common.materialize(across(common.materialize(open_.join(facts.select("rep"), "rep"), "viable")), "open")
    meet = open_.join(open_.groupBy("band").agg(F.min("rep").alias("first")), "band")
    clusters = graph.components(common.materialize(meet.select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), "meet"))
    clusters = clusters.select(F.col("node").alias("rep"), F.col("label").alias("cluster"))
    members = common.materialize(open_.select("rep", "label").distinct().join(facts, "rep").join(clusters, "rep"), "members")
    differing = common.materialize(deviations(held, members, percent), "deviations")
    labels = graph.extend(labels, common.materialize(joined(differing, percent), "links"))
    component = common.materialize(named(classes.select("set_key", "rep")).select("set_key", F.col("label").alias("component")), "named")
    out = sk.join(component, "set_key", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
