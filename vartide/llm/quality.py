"""Quality rules combined by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the
votes, without labels, estimates how often each rule is right for good and for bad documents; the
posterior probability of a good document replaces all-must-pass filtering. The votes enter only as
counts per pattern of votes: one partial aggregation to at most 3^rules rows at any input size, over
which the few arithmetic steps of each iteration run on the driver.

Defined cases: null text has no words and, like every text under 50 words, fails the base rule;
repeated rows vote each for itself; equal texts get equal verdicts; a value on the bound between two votes counts
as the vote it bounds, a probability of exactly the threshold as good; very long texts are measured whole, in
their row; an empty table gives an empty result (the priors stand); other columns do not matter and clash with nothing, as features stay in
one struct.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vartide.llm import common

#: Symbols of the contract.
SYMBOLS = r"[#*$%&|<>]"


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, first occurrences included.

    Window hashes sorted with their positions bring equal windows side by side: n log n in the row."""
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.lit(0), F.get(words, i + 1), F.lit(1), F.get(words, i + 2)).alias("h"), i.alias("at"))))

    def positions(w: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(w, j)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(w, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return F.coalesce(common.let(F.sort_array(windows), lambda w: common.let(positions(w), covered)), F.lit(0)).cast("long")


def features(text: str = "text") -> Column:
    """All counts as one struct; words are runs of anything but ASCII white space."""
    body = common.text_or_empty(text)

    def of(words: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, " \t\r\x0b\x0c", "")) > 0)
        bare = F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            common.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.regexp_count(bare, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(bare, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
            F.regexp_count(body, F.lit(r"[!?#*$%&|<>]+(?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_marked"),
            F.regexp_count(bare, F.lit(r"[!?]")).cast("long").alias("n_shouts"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        )

    return common.let(F.regexp_extract_all(body, F.lit(common.SPACE_WORD), F.lit(0)), of)


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def _vote(value: Column, good: float, bad: float) -> Column:
    """1 up to `good`, -1 from `bad` on, 0 between (either order of the bounds)."""
    if good <= bad:
        return F.when(value <= good, 1).when(value >= bad, -1).otherwise(0)
    return F.when(value >= good, 1).when(value <= bad, -1).otherwise(0)


def votes(f: Column) -> dict[str, Column]:
    words, chars = F.greatest(f["n_words"], F.lit(1)), F.greatest(f["word_chars"], F.lit(1))
    return {
        "symbols": _vote(f["n_symbols"] / words, 0.05, 0.25),
        "letters": _vote(f["n_letters"] / chars, 0.9, 0.8),
        "marked_words": _vote(f["n_marked"] / words, 0.1, 0.3),
        "dup_lines": _vote(f["n_dup_lines"] / F.greatest(f["n_lines"], F.lit(1)), 0.15, 0.5),
        "repeats": _vote(f["n_repeat_words"] / words, 0.25, 0.45),
        "capitals": _vote(f["n_upper"] / chars, 0.15, 0.5),
        "shouts": _vote(f["n_shouts"] / words, 0.05, 0.3),
        "variety": _vote(f["n_distinct"] / words, 0.3, 0.1),
    }


def pattern(v: dict[str, Column]) -> Column:
    """The votes in one whole number, base 3: the key of the counts and of the posterior."""
    code = F.lit(0)
    for k, x in enumerate(v.values()):
        code = code + (x + 1) * 3**k
    return code.cast("int")


class LabelModel:
    """Accuracies of rules by expectation-maximisation over counts of vote patterns.

    A rule's votes are independent given the class; each class and rule has its own probabilities of
    bad, none and good. Starting values say that rules are right more often than not, which fixes which
    class is which; Dirichlet pseudo-counts keep a rule that never votes, and small inputs, defined."""

    def __init__(self, rules: int, prior_good: float = 0.8, strength: float = 5.0):
        self.rules, self.good, self.strength = rules, prior_good, strength
        self.start = {1: (0.02, 0.18, 0.8), 0: (0.3, 0.2, 0.5)}
        self.p = {c: [list(self.start[c]) for _ in range(rules)] for c in (0, 1)}

    def posterior(self, code: int) -> float:
        up = log(self.good) - log(1 - self.good)
        for k in range(self.rules):
            v = code // 3**k % 3
            up += log(self.p[1][k][v]) - log(self.p[0][k][v])
        return 1 / (1 + exp(-max(-700.0, min(700.0, up))))

    def fit(self, counts: dict[int, int], rounds: int = 50) -> LabelModel:
        for _ in range(rounds):
            mass = {c: [[self.strength * x for x in self.start[c]] for _ in range(self.rules)] for c in (0, 1)}
            total = {1: 8.0, 0: 2.0}
            for code, n in counts.items():
                q = self.posterior(code)
                for c, w in ((1, n * q), (0, n * (1 - q))):
                    total[c] += w
                    for k in range(self.rules):
                        mass[c][k][code // 3**k % 3] += w
            self.good = total[1] / (total[0] + total[1])
            self.p = {c: [[x / sum(m) for x in m] for m in mass[c]] for c in (0, 1)}
        return self


def fit(scored: DataFrame) -> LabelModel:
    """scored: a table with `f` and `pattern`. What the base rule rejects is decided already and would
    make the short and the repetitive a class of their own, so the model learns from the others."""
    counts = {r[0]: r[1] for r in scored.filter(~base_failed(F.col("f"))).groupBy("pattern").agg(F.count("*")).collect()}  # at most 3^8 rows
    return LabelModel(8).fit(counts)


def posterior(model: LabelModel, code: Column) -> Column:
    """Lookup of the posterior in a literal array over all patterns (3^rules, fixed)."""
    values = ",".join(f"{model.posterior(c):.6f}" for c in range(3**model.rules))
    return F.get(F.from_json(F.lit(f"[{values}]"), "array<double>"), code)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' doc_id with features `f` and the vote pattern."""
    rows = docs.select("doc_id", features(text).alias("f"))
    return rows.withColumn("pattern", pattern(votes(F.col("f"))))


def judge(measured: DataFrame, threshold: float = 0.5) -> DataFrame:
    """measured with base_failed, p_good and kept; reads its input twice, so give it a table."""
    model = fit(measured)
    out = measured.withColumn("base_failed", base_failed(F.col("f"))).withColumn("p_good", posterior(model, F.col("pattern")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
