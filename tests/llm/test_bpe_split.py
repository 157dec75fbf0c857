"""The splitter's written-out classes give the matches of the regex module; merges by ids those by bytes."""

import random

import pytest

regex = pytest.importorskip("regex")
P = pytest.importorskip("public_tokenizers")

from vartide.llm import bpe  # noqa: E402


def test_splitter_gives_the_matches_of_the_pattern():
    split, plain, r = bpe.splitter(P.PATTERN), regex.compile(P.PATTERN).findall, random.Random(3)
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    assert split("".join(every)) == plain("".join(every))
    for _ in range(3000):
        n = r.randint(0, 30)
        for t in ("".join(r.choice(every if r.random() < 0.3 else " \n\t'strevmld'12é中\x1c\x85\x0b\xa0  .,") for _ in range(n)), "".join(chr(r.choice([r.randrange(128), 32, 10, 39, 115])) for _ in range(n))):
            assert split(t) == plain(t)
    for other in (r"\p{Lu}+|\w", r"(?i:ab)|\d+"):
        assert bpe.splitter(other)("Ab12 aB") == regex.compile(other).findall("Ab12 aB")


def test_short_and_long_merges_agree():
    ranks, r = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), random.Random(5)
    for _ in range(3000):
        w = bytes(r.choice(b"aeiouthndr \xc3\xa9\xe4\xb8\xad01'") for _ in range(r.randint(1, 60)))
        assert bpe.merge_short(w, ranks) == bpe.merge_long(w, ranks)
