"""What op8's tasks do for each text and word: no slower for letters beyond ASCII, new words merged many at once."""

import hashlib
import random
import time

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from vartide.llm import bpe  # noqa: E402


def seconds(f, *args):
    def once():
        start = time.process_time()
        f(*args)
        return time.process_time() - start

    return min(once() for _ in range(5))


def test_splitting_costs_the_same_beyond_ascii():
    r, split = random.Random(1), bpe.splitter(P.PATTERN)
    plain = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) + r.choice(["", ".", ","]) for _ in range(50_000))
    accents = plain.translate(dict(zip(map(ord, "aceg"), "éàßж", strict=True)))
    assert len(split(plain)) == len(split(accents))
    assert seconds(split, accents) < 3 * seconds(split, plain)  # 6 times when all ranges were walked through


def test_merges_of_many_words_are_those_of_one():
    ranks, r = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), random.Random(2)
    enc = tiktoken.Encoding("t", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(r.choice("aeiouthndr é中\U0001f600ж01'") for _ in range(r.randint(1, 40))) for _ in range(4000)]
    words += ["", "a", "中", "aaaa" * 16, "a" * 64, "a" * 65, "x" * 900, words[0], words[0]] + ["ab" * k for k in range(40)]
    raw, pairs = [w.encode() for w in words], bpe.pair_ranks(ranks)
    assert bpe.merge_words(raw, ranks) == bpe.merge_words(raw, ranks, pairs) == [enc.encode_ordinary(w) for w in words]
    assert bpe.merge_words([], ranks) == [] and bpe.merge_words([b""], ranks) == [[]]
    raw = sorted({w for k in range(20_000) if (w := bytes(r.choice(b" aeiouthndrsl") for _ in range(11))) not in ranks})
    assert seconds(bpe.merge_words, raw, ranks, pairs) < 0.9 * seconds(lambda: [bpe.merge_word(w, ranks) for w in raw])


def test_words_are_forgotten_and_met_again(spark, monkeypatch):
    ranks, r = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), random.Random(3)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = bpe.Words(bpe.CACHE_SCHEMA.empty_table(), ranks, bpe.pair_ranks(ranks), most=10)
    for w in ("hello", "zqxjkvw", "hello", " é中", "x" * 3000, "zqxjkvw", "hello"):
        at = words[w]
        words.settle()
        assert words.ids[at] == ",".join(map(str, enc.encode_ordinary(w))) and words.decoded[at] == w.encode()
        words.forget()
        assert len(words) == len(words.ids) == len(words.decoded) == 0  # ten for the word alone, and its letters
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 0)
    monkeypatch.setattr(bpe, "KEPT_CHARS", 50)
    texts = [" ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 12))) for _ in range(30)) for _ in range(40)] + ["", None, "\U0001f600 a\U0001f601's", "y" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {x.doc_id: x for x in bpe.encode(df, ranks, P.PATTERN, bpe.cache_of(df, ranks, P.PATTERN, 20), with_ids=True).collect()}
    for k, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert (list(got[k].ids), got[k].n_tokens, got[k].decoded_sha256) == (ids, len(ids), hashlib.sha256((t or "").encode()).hexdigest())
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
