"""The eight rules, the label model and the verdicts, recomputed without Spark."""

import collections
import math

import pytest

regex = pytest.importorskip("regex")

from test_operators import quality_by_force, texts  # noqa: E402

from vartide.llm import common, quality  # noqa: E402

#: Rule: good and bad bound, as stated in the operator.
BOUNDS = [("symbols", 0.05, 0.25), ("letters", 0.9, 0.8), ("marked_words", 0.1, 0.3), ("dup_lines", 0.15, 0.5), ("repeats", 0.25, 0.45), ("capitals", 0.15, 0.5), ("shouts", 0.05, 0.3), ("variety", 0.3, 0.1)]


def votes_by_force(t):
    t = t or ""
    n, chars, symbols, dup, repeated = quality_by_force(t)
    words = regex.findall(r"[^\x20\x09-\x0D]+", t)
    bare, lines = "".join(words), [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
    n, chars = max(n, 1), max(chars, 1)
    marked = sum(bool(regex.search(r"[!?#*$%&|<>]+$", w)) for w in words)
    values = [symbols / n, len(regex.findall(r"\p{L}", bare)) / chars, marked / n, dup / max(len(lines), 1), repeated / n, len(regex.findall(r"\p{Lu}", bare)) / chars, sum(c in "!?" for c in bare) / n, len(set(words)) / n]
    out = []
    for value, (_, good, bad) in zip(values, BOUNDS, strict=True):
        sign = 1 if good <= bad else -1
        out.append(1 if sign * value <= sign * good else -1 if sign * value >= sign * bad else 0)
    return tuple(out)


def model_by_force(patterns):
    """Posterior of good by pattern, from expectation-maximisation over whole documents' votes."""
    start = {1: (0.02, 0.18, 0.8), 0: (0.3, 0.2, 0.5)}
    p, good = {c: [list(start[c]) for _ in BOUNDS] for c in (0, 1)}, 0.8

    def posterior(votes):
        up = math.log(good / (1 - good)) + sum(math.log(p[1][k][v + 1] / p[0][k][v + 1]) for k, v in enumerate(votes))
        return 1 / (1 + math.exp(-up))

    for _ in range(50):
        weights = [posterior(v) for v in patterns]
        sums = {c: [[5.0 * x for x in start[c]] for _ in BOUNDS] for c in (0, 1)}
        for v, w in zip(patterns, weights, strict=True):
            for k, x in enumerate(v):
                sums[1][k][x + 1] += w
                sums[0][k][x + 1] += 1 - w
        good = (8 + sum(weights)) / (10 + len(patterns))
        p = {c: [[x / sum(row) for x in row] for row in sums[c]] for c in (0, 1)}
    return posterior


@pytest.mark.parametrize("source", ["awkward", "tables"])
def test_votes_and_verdicts(spark, source):
    if source == "tables":
        rows = [(r.doc_id, r.text) for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    else:
        made = texts() + ["WHAT!! NOW?? " * 40, "#1 $2 %3 <a> | & " * 20, "Word " * 10 + "other words here " * 30, "one line\n" * 60, "a!! b?? plain words and more " * 12]
        rows = list(enumerate(made * 2))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = quality.judge(common.materialize(quality.measure(df), "measured")).collect()
    cast = {i: votes_by_force(t) for i, t in rows}
    failed = {i: (lambda f: f[0] < 50 or 100 * f[4] > 50 * f[0])(quality_by_force(t)) for i, t in rows}
    posterior = model_by_force([v for i, v in cast.items() if not failed[i]])
    assert len(got) == len(rows) and collections.Counter(r.base_failed for r in got)[True] == sum(failed.values())
    for r in got:
        votes = tuple(r.pattern // 3**k % 3 - 1 for k in range(8))
        assert votes == cast[r.doc_id], r.doc_id
        p = posterior(votes)
        assert r.p_good == pytest.approx(p, abs=1e-5)
        assert abs(p - 0.5) < 1e-5 or r.kept == (not failed[r.doc_id] and p >= 0.5)
