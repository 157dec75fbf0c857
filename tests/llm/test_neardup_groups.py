"""Links that neither a bucket's smallest nor its central member shows."""

import random

import pytest
from test_operators import components_by_force, shingle_set, words

from vartide.llm import neardup


def test_pairs_far_from_the_middle(spark, monkeypatch):
    """Pairs of versions that are close to each other but not to any third, all in the same buckets."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    r, base, rows = random.Random(12), words(150, 31, 4000), []
    ids = r.sample(range(1000), 80)
    for k in range(20):
        version = list(base)
        for at in r.sample(range(0, 150, 6), 5):
            version[at] = f"own{r.randrange(12)}"
        near = list(version)
        near[r.randrange(150)] = "more"
        rows += [(ids[4 * k], " ".join(version)), (ids[4 * k + 1], " ".join(near)), (ids[4 * k + 2], " ".join(version))]
    rows += [(ids[3], None), (ids[7], ""), (ids[11], " ".join(words(3000, 32)))]
    force = components_by_force(rows, 85)
    assert len(set(force.values())) > 8
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == force


def classes_by_force(rows, percent):
    """The same as components_by_force from one look at every pair."""
    sets, root = [(i, shingle_set(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def below_the_threshold(n, seed=5):
    """Pages of one template of 370 words, four slots of each filled with words of its own: most pairs are just below .85."""
    r, base = random.Random(seed), words(370, 33, 9000)
    rows = []
    for k in range(n):
        page = list(base)
        for j, at in enumerate(r.sample(range(370), 4)):
            page[at] = f"own{k}x{j}"
        rows.append((k, " ".join(page)))
    return rows


def test_pairs_grow_as_the_group(spark, monkeypatch):
    """Twice the pages of such a group: at most about twice the pairs that are verified or joined, and the same components as
    from all pairs."""
    made, verify, joined = [], neardup.verify, neardup.joined
    monkeypatch.setattr(neardup, "verify", lambda pairs, *a: made.append(pairs.count()) or verify(pairs, *a))
    monkeypatch.setattr(neardup, "joined", lambda *a: (lambda out: made.append(out.count()) or out)(joined(*a)))
    sizes = []
    for n in (300, 600):
        rows, start = below_the_threshold(n), len(made)
        got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        sizes.append(sum(made[start:]))
        assert got == classes_by_force(rows, 85)
    assert sizes[1] <= 2.5 * sizes[0] and sizes[1] <= 20 * 600


@pytest.mark.parametrize("percent", [80, 85])
def test_two_templates_and_chains_in_one_bucket(spark, percent):
    """Clusters without a majority, versions of versions, and members that need no difference in common."""
    r, a, b = random.Random(3), words(200, 41, 5000), words(200, 42, 5000)
    rows = []
    for k in range(60):
        page = list(a if k % 2 else b)
        page = page[:120] + (b if k % 2 else a)[120:] if k % 5 == 0 else page
        for at in r.sample(range(200), r.choice([0, 1, 2, 4, 5])):
            page[at] = f"own{r.randrange(40)}"
        rows.append((k, " ".join(page)))
    version = list(a)
    for k in range(60, 90):
        version = list(version)
        for at in r.sample(range(200), 3):
            version[at] = f"v{k}x{at}"
        rows.append((k, " ".join(version)))
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    assert got == classes_by_force(rows, percent)
