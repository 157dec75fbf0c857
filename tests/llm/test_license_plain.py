"""Rules, priorities and containment against a plain version over words."""

import random
import re

from vartide.llm import licenses

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(text):
    """(labels, score) by every rule at every place, each interval held against all others."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    spaced = f" {' '.join(words)} "
    found = [(m.start(), m.end(), p, label, sure) for label, _, rule, p, sure in licenses.RULES for m in re.finditer(f" (?:{rule})(?= )", spaced)]
    found.sort(key=lambda d: (d[0], -d[1], -d[2], d[3], d[4]))
    kept = []
    for k, (a, b, p, label, sure) in enumerate(found):
        inside = lambda j: found[j][0] <= a and b <= found[j][1]  # noqa: B023, E731
        if not any(inside(j) and (found[j][2] > p or (found[j][2] == p and j < k)) for j in range(len(found)) if j != k):
            kept.append((label, sure))
    base = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in spaced}
    score = max([s for _, s in kept], default=0.0)
    return ",".join(sorted(base | {x for x, _ in kept})), max(score, 0.75) if base else score


def test_labels_and_scores_by_hand(spark):
    r = random.Random(6)
    pieces = [re.sub(r"\[sc\]", "s", re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", rule)) for _, _, rule, *_ in licenses.RULES]
    pieces = [p.replace("[1-4]", "4").replace("[05]", "0").replace("(?: [0-9]+)*", " 2 0") for p in pieces]
    texts = [None, "", "no license here", "as is basis", "SPDX-License-Identifier: GPL-2.0-only under the terms of the GNU General Public License version 2"]
    for _ in range(150):
        texts.append(" ".join(r.choice([r.choice(pieces), "some other words", "licensed under the", "version 2 0", "the public domain", "and"]) for _ in range(r.randint(1, 9))))
    texts += ["MIT License and Apache License 2.0, " * 700, "word " * 400_000 + "released under the MIT License"]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    got = {x.doc_id: (x.labels, x.score) for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, spaced string, more int").repartition(4)).collect()}
    for k, t in enumerate(texts[:-2]):
        assert (got[k][0], round(got[k][1], 6)) == (plain(t)[0], round(plain(t)[1], 6)), t
    assert got[len(texts) - 2][0] == "apache,mit" and got[len(texts) - 1][0] == "mit"


def test_a_higher_priority_inside_a_longer_match_stays(spark):
    d = spark.createDataFrame([(1, "under the terms of the gnu general public license version 3"), (2, "x")], "doc_id long, text string")
    found = {x.doc_id: (x.labels, x.score) for x in licenses.scan(d).collect()}
    assert found == {1: ("gpl", 0.99), 2: ("", 0.0)}


def test_only_ascii_letters_are_lowered(spark):
    d = spark.createDataFrame([("MARK İX, MitÉ MIT",)], "text string")
    assert d.select(licenses.words_of().alias("w")).first().w == " marK İx mitÉ mit "
