"""Byte-level BPE: encoding by ranked merges over distinct words, decoding by concatenating pieces.

The merges are Spark higher-order functions: a word's bytes are an array of one-byte strings, and a fold
over the array joins the neighbours whose joined bytes have the least rank (leftmost of equals) until
no neighbours have one. Ranks are one literal: an array of small maps, found by the checksum of the bytes,
so a lookup costs the same for any vocabulary. `fold_words` does this for a table of distinct words.

Decoding concatenates binary pieces: `decode_ids` does it for an array of ids.

Whole texts are encoded by tasks that hold a dictionary of the CACHE_WORDS most frequent words of the
corpus, folded and decoded that way (a fixed bound, sent to the executors once, as Arrow bytes). It only
saves work: any other word is merged in its task by the same rule, the words of many texts at once, one merge
of each in a round over arrays (`merge_words`); words over FOLD_BYTES go over a heap, which keeps those of many
thousand bytes, for which a fold that rebuilds its array is quadratic, in n log n. A text's ids and its decoded
bytes are its words' one after the other. No text is ever shuffled.

Defined cases: null text is empty and has no ids; equal texts get equal ids; repeated rows repeat their
result; ties of ranks go to the leftmost pair; any byte has an id, so every text round-trips; very long texts
and words are encoded whole; an empty table gives an empty result; extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vartide.llm import common

CACHE_WORDS, FOLD_BYTES, SLOTS = 1 << 16, 64, 1 << 14

#: Characters of texts, or new words in them, after which words are merged; characters of words that a task keeps
#: beyond its dictionary, each word counted as ten more.
CHUNK_CHARS, CHUNK_WORDS, KEPT_CHARS = 4_000_000, 1 << 17, 12_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 of a token and its rank, one on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal: an array of SLOTS maps from byte strings (Latin-1) to ranks."""
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for token, rank in ranks.items():
        name = token.decode("latin-1")
        slots[zlib.crc32(name.encode()) % SLOTS][name] = rank
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<map<string,int>>")


def fold_merges(word: Column, literal: Column) -> Column:
    """Ids of a binary word, by a fold over its array of bytes."""
    latin = F.decode(word, "ISO-8859-1")
    rank = lambda x: F.try_element_at(F.get(literal, F.pmod(F.crc32(F.encode(x, "UTF-8")), F.lit(SLOTS)).cast("int")), x)

    def ranks_of(parts: Column) -> Column:
        return F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x, i: rank(F.concat(x, F.get(parts, i + 1))))

    def step(state: Column, _: Column) -> Column:
        parts, ranks = state["parts"], state["ranks"]

        def merge(at: Column) -> Column:  # at counts from 1
            joined = F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))
            before = F.when(at > 1, F.array(rank(F.concat(F.get(parts, at - 2), joined)))).otherwise(F.array().cast("array<int>"))
            after = F.when(at + 1 < F.size(parts), F.array(rank(F.concat(joined, F.get(parts, at + 1))))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(parts, F.lit(1), at - 1), F.array(joined), F.slice(parts, at + 2, F.size(parts))).alias("parts"),
                F.concat(F.slice(ranks, F.lit(1), F.greatest(at - 2, F.lit(0))), before, after, F.slice(ranks, at + 2, F.size(parts))).alias("ranks"),
            )

        least = F.array_min(ranks)
        return F.when(least.isNull(), state).otherwise(common.let(F.array_position(ranks, least).cast("int"), merge))

    def run(parts: Column) -> Column:
        start = F.struct(parts.alias("parts"), ranks_of(parts).alias("ranks"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), start, step, lambda s: F.transform(s["parts"], rank))

    return common.let(F.split(latin, ""), run)


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by the same rule: over a list of parts while that is short, else over a heap."""
    if word in ranks:
        return [ranks[word]]
    return merge_short(word, ranks) if len(word) <= FOLD_BYTES else merge_long(word, ranks)


_JOINS: dict[int, tuple[dict[bytes, int], list[int], list[dict[int, int]]]] = {}


def joins_of(ranks: dict[bytes, int]) -> tuple[list[int], list[dict[int, int]]]:
    """The id of each byte; for each id a map from the ids that may follow it to the id of both joined."""
    if id(ranks) not in _JOINS:
        follow: list[dict[int, int]] = [{} for _ in range(max(ranks.values()) + 1)]
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    follow[a][b] = rank
        _JOINS.clear()
        _JOINS[id(ranks)] = (ranks, [ranks[bytes([k])] for k in range(256)], follow)
    return _JOINS[id(ranks)][1:]


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    single, follow = joins_of(ranks)
    none = len(follow)
    parts = [single[x] for x in word]
    found = [follow[a].get(b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while found and (least := min(found)) < none:
        i = found.index(least)
        parts[i] = least
        del parts[i + 1], found[i]
        if i:
            found[i - 1] = follow[parts[i - 1]].get(least, none)
        if i < len(found):
            found[i] = follow[least].get(parts[i + 1], none)
    return parts


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same over ranked neighbours in a heap and linked parts: n log n."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[x], i, i + 2) for i in range(n - 1) if (x := word[i : i + 2]) in ranks]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop or not alive[i]:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


def pair_ranks(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ids that join, as first * (greatest id + 1) + second in order, and the ids that they become.
    A last key that no pair has ends them, so that a search always finds a place."""
    size, found = max(ranks.values()) + 1, {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                found[a * size + b] = rank
    keys = np.array(sorted(found), np.int64)
    return np.append(keys, size * size), np.array([*map(found.get, keys.tolist()), size], np.int32)


def merge_words(words: list[bytes], ranks: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray] | None = None) -> list[list[int]]:
    """What `merge_word` gives for each word. A round takes all words that have `width` parts left, as the columns
    of one array, and joins in each its pair of least rank, the leftmost of equals; words that have none are ready,
    all others are one part shorter and meet the words that begin with that many bytes. pairs: `pair_ranks`."""
    keys, joined = pair_ranks(ranks) if pairs is None else pairs
    none, out = max(ranks.values()) + 1, [[ranks[w]] if w in ranks else None for w in words]
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if out[k] is None and w:
            by_length.setdefault(len(w), []).append(k)
        elif not w:
            out[k] = []
    for n in [n for n in by_length if n > FOLD_BYTES]:
        for k in by_length.pop(n):
            out[k] = merge_long(words[k], ranks)
    single = np.array([ranks[bytes([k])] for k in range(256)], np.int32)

    def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * none + b
        at = keys.searchsorted(key)
        return np.where(keys[at] == key, joined[at], none).astype(np.int32)

    def ready(which: np.ndarray, parts: np.ndarray) -> None:
        for k, ids in zip(which.tolist(), parts.T.tolist(), strict=True):
            out[k] = ids

    of_bytes = rank(np.repeat(single, 256), np.tile(single, 256))
    longest = max(by_length, default=1)
    which, parts, found = np.zeros(0, np.int64), np.zeros((longest, 0), np.int32), np.zeros((longest - 1, 0), np.int32)
    for width in range(longest, 1, -1):
        if starting := by_length.get(width):
            raw = np.frombuffer(b"".join([words[k] for k in starting]), np.uint8).reshape(-1, width).T
            which = np.append(which, starting)
            parts = np.concatenate([parts, single[raw]], 1)
            found = np.concatenate([found, of_bytes[raw[:-1].astype(np.int32) * 256 + raw[1:]]], 1)
        place = np.arange(width - 1, dtype=np.int32)[:, None]
        least = (found * FOLD_BYTES + place).min(0)  # rank first, then place: below FOLD_BYTES in these words
        go = least < none * FOLD_BYTES
        if not go.all():
            ready(which[~go], parts[:, ~go])
            which, parts, found, least = which[go], parts[:, go], found[:, go], least[go]
        least, i = np.divmod(least, FOLD_BYTES)
        parts = np.where(place <= i, parts[:-1], parts[1:])
        parts[i, np.arange(len(i))] = least
        found = np.where(place[:-1] < i, found[:-1], found[1:])
        (k,) = (i > 0).nonzero()
        found[i[k] - 1, k] = rank(parts[i[k] - 1, k], least[k])
        (k,) = (i < width - 2).nonzero()
        found[i[k], k] = rank(least[k], parts[i[k] + 1, k])
    ready(which, parts)
    return out


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """word (binary) and n over all texts, counted in tasks before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = splitter(pattern), Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()).cast(pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for text in b.column(0):
                found.update(split(text.as_py() or ""))
                if len(found) > 300_000:
                    yield rows()
                    found.clear()
        yield rows()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fold_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """word and ids for a table of distinct words of at most FOLD_BYTES bytes."""
    return words.filter(F.octet_length("word").between(1, FOLD_BYTES)).select("word", fold_merges(F.col("word"), rank_literal(ranks)).alias("ids"))


@cache
def _members(name: str, most: int) -> str:
    """The characters of a class such as \\p{L} up to the code point `most`, as ranges inside [ ]."""
    import regex

    every = "".join(map(chr, [*range(min(most + 1, 0xD800)), *range(0xE000, most + 1)]))
    return "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for m in regex.finditer(name + "+", every))


@cache
def splitter(pattern: str):
    """All matches of the pattern, as a function of a text. A `+` that ends an alternative is made possessive:
    nothing follows it that could take a character back, so the matches are the same and the engine keeps no
    positions. Classes are written out for the standard engine, up to U+007F for texts in ASCII and else up to
    U+FFFF, as it finds characters there by a table but walks through all ranges beyond. Texts with characters
    beyond, and patterns with other properties than letters, numbers and white space, go to the `regex` module."""
    import re

    import regex

    pattern = re.sub(r"(?<=[\]}s])\+(?=\||$)", "++", pattern)
    plain = regex.compile(pattern).findall
    if re.search(r"\\[pP](?!\{[LN]\})|\\[^pPsS]|\(\?(?![!=:])", pattern):
        return plain

    def written(most: int) -> str:
        known = {k: _members(k, most) for k in (r"\s", r"\p{L}", r"\p{N}")}
        inside = lambda m: re.sub(r"\\s|\\p\{[LN]\}", lambda x: known[x[0]], m[0])
        out = re.sub(r"\[[^\]]*\]", inside, pattern)
        return re.sub(r"(\\s|\\p\{[LN]\})|\\S", lambda m: f"[{known[m[1]]}]" if m[1] else f"[^{known[chr(92) + 's']}]", out)

    short, wide = re.compile(written(0x7F)).findall, re.compile(written(0xFFFF)).findall
    beyond = lambda text: len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
    return lambda text: (short if text.isascii() else plain if beyond(text) else wide)(text)


class Words(dict):
    """For each word its place in `ids` (comma-joined decimals) and `decoded` (the bytes that they decode to).
    Words that the given ones (word, ids, decoded) lack get the next places; `settle` merges them."""

    def __init__(self, known: pa.Table, ranks: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray], most: int):
        super().__init__(zip(known["word"].cast(pa.string()).to_pylist(), range(len(known)), strict=True))
        self.ids, self.decoded, self.given = known["ids"].to_pylist(), known["decoded"].to_pylist(), len(known)
        self.ranks, self.pairs, self.most, self.chars, self.new = ranks, pairs, most, 0, []
        self.pieces, self.names = [b""] * (max(ranks.values()) + 1), [str(k) for k in range(max(ranks.values()) + 1)]
        for token, rank in ranks.items():
            self.pieces[rank] = token

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        at = self[word] = len(self)
        return at

    def settle(self) -> None:
        """Merge the words met since the last call."""
        pieces, names = self.pieces, self.names
        for at in range(0, len(self.new), 1 << 15):
            for ids in merge_words([w.encode() for w in self.new[at : at + (1 << 15)]], self.ranks, self.pairs):
                self.ids.append(",".join([names[i] for i in ids]))
                self.decoded.append(b"".join([pieces[i] for i in ids]))
        self.chars += sum(map(len, self.new)) + 10 * len(self.new)
        self.new.clear()

    def forget(self) -> None:
        """Once merged words have over `most` characters (ten more for each), keep the given ones alone. Places of others end here."""
        if self.chars > self.most:
            while len(self) > self.given:
                self.popitem()
            del self.ids[self.given :], self.decoded[self.given :]
            self.chars = 0


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of counts (word, n) from some count on, at most `most`. The bound comes from a histogram of
    counts in logarithmic steps, a few thousand rows at any input size, so nothing is sorted."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    histogram = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("step")).agg(F.count("*")).collect()), reverse=True)
    least, total = None, 0
    for k, n in histogram:
        total += n
        if total > most:
            break
        least = k
    return counts.filter(step >= least) if least is not None else counts.limit(0)


def decode_ids(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Bytes of an array of ids: the pieces, from a literal array, one after the other."""
    size = max(ranks.values()) + 1
    pieces = [""] * size
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""))


#: What a dictionary of words holds: the word, its ids as comma-joined decimals, the bytes they decode to.
CACHE_SCHEMA = pa.schema([("word", pa.binary()), ("ids", pa.string()), ("decoded", pa.binary())])


def cache_of(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = CACHE_WORDS) -> pa.Table:
    """CACHE_SCHEMA of at most `most` of the most frequent words of docs, folded and decoded by Spark."""
    counts = common.materialize(word_counts(docs, pattern), "words")
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    folded = common.materialize(fold_words(frequent(counts, most).repartition(parts, "word"), ranks), "folded")
    return folded.select("word", F.array_join("ids", ",").alias("ids"), decode_ids(F.col("ids"), ranks).alias("decoded")).toArrow().cast(CACHE_SCHEMA)  # at most `most` short rows


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, known: pa.Table | dict | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids, comma-joined), decoded_sha256 (of the bytes that the ids
    decode to) and, with_ids, the ids themselves. known: what `cache_of` returns, or nothing."""
    known = known if isinstance(known, pa.Table) else CACHE_SCHEMA.empty_table()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as writer:
        writer.write_table(known)
    raw = sink.getvalue().to_pybytes()
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pair_ranks(ranks), raw))
    chunk, kept = CHUNK_CHARS, KEPT_CHARS
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pairs, raw = shared.value
        split, words = splitter(pattern), Words(pa.ipc.open_stream(raw).read_all(), ranks, pairs, kept)
        of, ids, decoded = words.__getitem__, words.ids, words.decoded

        def rows_of(texts: list[tuple[int, list[int]]]) -> Iterator[tuple]:
            words.settle()
            for doc_id, found in texts:
                said = ",".join([ids[k] for k in found])
                back = hashlib.sha256(b"".join([decoded[k] for k in found])).hexdigest()
                n = said.count(",") + 1 if said else 0
                yield doc_id, n, hashlib.sha256(said.encode()).hexdigest(), back, *[list(map(int, said.split(","))) if n else []] * with_ids
            words.forget()

        for b in batches:
            rows, texts, chars = [], [], 0
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = text.as_py() or ""
                texts.append((doc_id, list(map(of, split(text)))))
                chars += len(text)
                if chars > chunk or len(words.new) > CHUNK_WORDS:
                    rows.extend(rows_of(texts))
                    texts, chars = [], 0
            rows.extend(rows_of(texts))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: len(names)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
