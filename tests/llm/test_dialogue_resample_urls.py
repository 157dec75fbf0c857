"""Structure repair, importance resampling and URL filters against plain versions, on awkward rows and hot groups."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import pytest

duckdb = pytest.importorskip("duckdb")

from pyspark.sql import functions as F  # noqa: E402

from vartide.llm import common, dialogue, oracles, queries, resample, urls  # noqa: E402

SPACES = " \t\n\x0b\x0c\r"


def damaged_by_force(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    said = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, said(r)))


def faults_by_force(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        end = text.rstrip(SPACES)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    return out


def repaired_by_force(turns, faults):
    """Best first over every sequence of edits; nothing but the grammar is known of states. Cost, audit, repaired turns."""
    legal = re.compile("s?(ua)*u?")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, said = heapq.heappop(heap)
        key = (at, roles[-1:] if len(roles) < 2 else roles[-1])
        if key in done:
            continue
        done.add(key)
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, said
        moves = [("I", 5, r, (r, "")) for r in ("user", "assistant")]
        if at < len(turns):
            role, text = turns[at][2:]
            more = 5 if faults[at] == "truncated" else 0
            moves.append(("D", 2, None, None))
            if faults[at] not in ("blank", "duplicate"):
                moves += [("K", more, role, (role, text))] + [("R", 1 + more, r, (r, text)) for r in ("user", "assistant")]
        for letter, price, role, turn in moves:
            new = roles if role is None else roles + (role[:1] or "-")
            if legal.fullmatch(new):
                heapq.heappush(heap, (cost + price, audit + letter, at + (letter != "I"), new, said + ((turn,) if turn else ())))
    raise AssertionError


def conversations_by_force(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = damaged_by_force([r for r in rows if r[0] == conv])
        faults = faults_by_force(turns)
        cost, audit, said = repaired_by_force(turns, faults) if turns else (0, "", ())
        numbers = {t[1] for t in turns if t[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        initials = [t[2][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        count = collections.Counter(faults)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks():
    r = random.Random(11)
    rows = []
    for conv in [None, *range(160)]:
        for k in range(r.choice([1, 2, 3, 5, 8, 9])):
            turn = r.choice([None, k, k, k, k, 2 * k, 7])
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"])
            text = r.choice([None, "", " \t\n", "Fine.", "Fine.", "so", "what?\n ", "é中!", "x" * 3000, "no end\x85", "A|B."])
            rows += [(conv, turn, role, text)] * r.choice([1, 1, 1, 2, 3])
    return rows


def table(spark, rows):
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    return made.withColumns({c: F.lit("mine") for c in ("key", "place", "fault", "said", "n", "kind", "copy")})


@pytest.mark.parametrize("most", [1, 3, 512])
def test_repairs_as_by_force(spark, talks, most):
    expected = conversations_by_force(talks)
    figures, turns = dialogue.repair(dialogue.damage(table(spark, talks)), most)
    sha = {r.conv_id: r.sha256 for r in dialogue.digests(turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha.get(r.conv_id, empty)) for r in figures.collect()}
    for conv, row in expected.items():
        assert got.get(conv, (0, 0, 0, 0, 0, 0, "", empty)) == row, conv


def test_one_conversation_spreads_over_tasks(spark):
    """A conversation of 4000 turns is cut into chunks of several tasks, with the result of a single pass; a turn repeated 3000 times is one row."""
    r = random.Random(3)
    rows = [(1, k, r.choice(["user", "assistant", "assistant", "system"]), f"turn {r.randint(0, 3000)}{r.choice('.!?,')}") for k in range(4000)] + [(1, 5000, "user", "again.")] * 3000
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = dialogue.chunks(dialogue.faults(common.materialize(dialogue.narrow(turns), "narrow")), 200).withColumn("part", F.spark_partition_id())
        parts = common.materialize(parts, "parts")
        assert parts.select("part").distinct().count() > 1 and parts.agg(F.max(F.size("keys"))).first()[0] <= 200 and parts.agg(F.sum("n")).first()[0] == 7000
        figures, repaired = dialogue.repair(turns, 200)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    said = lambda x: hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()
    rows = sorted(rows, key=lambda x: (x[1], said(x)))
    faults = [dialogue.FAULTS.index(f or "none") for f in faults_by_force(rows)]
    cells = dialogue.closed([(0, ""), None, None, None])
    for row, fault in zip(rows, faults, strict=True):
        cells = dialogue.step(cells, row[2][:1], fault, 1)
    best = min(c for k, c in enumerate(cells) if c is not None and k in dialogue.ENDS)
    got = figures.first()
    assert (got.cost, got.audit) == best and got.gaps == 1000 and got.n == 7000
    roles = "".join(x.role[0] for x in repaired.sort("place.turn", "place.said", "at").collect())
    assert re.fullmatch("(s?(ua)+)?", roles)


def test_no_conversations(spark):
    figures, turns = dialogue.repair(dialogue.damage(table(spark, [])))
    assert figures.collect() == [] and dialogue.digests(turns).collect() == []


def weights_by_force(rows, target):
    grams = lambda t: (lambda w: [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)])(terms(t))
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = (collections.Counter(bucket(g) for x in texts for g in grams(x)) for texts in ([x for _, x in rows], target))
    total = [sum(c.values()) for c in (s, t)]
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total[0] + 10000) / ((s[b] + 1) * (total[1] + 10000)))) for b in s}
    out = []
    for i, x in rows:
        g = grams(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(y)] for y in g)
        out.append((i, len(terms(x)), len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_resampling_as_by_force(spark):
    r = random.Random(5)
    vocabulary = ["and", "Éa", "THE", "x" * 63, "y" * 64, "z" * 65, "é" * 5000, "q" * 70_000, "a1", "b-c", "中文", "\x85", "İ"]
    rows = [(k if k % 9 else None, " ".join(r.choice(vocabulary[: 6 if k % 5 else 13]) for _ in range(r.randint(0, 60)))) for k in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " .,\n"), (1003, "one"), *[(1004, "same words again " * 12)] * 40]
    target = ["and the x1", None, "", "THE and the Éa " * 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit("mine") for c in ("bucket", "weight", "rank", "row", "_at", "n")})
    got = resample.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), percent=30).collect()
    expected = weights_by_force(rows, target)
    assert collections.Counter((x.doc_id, x.n_words, x.n_features, x.weight, x.score) for x in got) == collections.Counter(expected)
    enough = sorted((e for e in expected if e[1] >= 20), key=lambda e: (-e[4], e[0] is None, e[0] or 0))
    drawn = sorted((x for x in got if x.rank is not None), key=lambda x: x.rank)
    assert [x.rank for x in drawn] == list(range(1, 30 * len(enough) // 100 + 1))
    assert [(x.score, x.doc_id) for x in drawn] == [(e[4], e[0]) for e in enough[: len(drawn)]]


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).collect() == []
    one = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert [x.rank for x in resample.resample(one, none, percent=100).collect()] == [1]


def test_shifts_are_those_of_zlib():
    import numpy as np

    r = random.Random(8)
    pairs = [(bytes(r.randbytes(r.randint(0, 50))), bytes(r.randbytes(n))) for n in (0, 1, 63, 64, 65, 127, 128, 4097, 100_000)]
    crc = np.array([zlib.crc32(a) for a, _ in pairs], np.uint32)
    sizes = np.array([len(b) for _, b in pairs], np.int64)
    both = resample.shift(crc, sizes) ^ np.array([zlib.crc32(b) for _, b in pairs], np.uint32)
    assert both.tolist() == [zlib.crc32(a + b) for a, b in pairs]


URLS = [
    None, "", "no scheme", "http://", "https://NET/", "http://net", "http://a.NET/x", "http://planet/x", "http://example.net/en/1", "http://m.Example.net/en", "http://example.net/en/", "http://notexample.net/en/a",
    "x://example.com/de/a?b=/en/", "http://example.com?/de/", "http://example.com#/de/", "http://b.example.com/DE/", "http://w.org/fr/x", "http://org/fr/", "http://spam-farm.org/fr/1", "http://spam-farm.org/en/", "http://my.ads.example.com/en/",
    "http://ads-track.example.com/de/", "http://badspam.org/", "http://a/b://net/x", "http://u:p@net:80/", "http://net./", "http://.net/", "http://é.net/é?x", "http://xxx", "http://casino\n/x", "http://" + "a." * 50_000 + "net/" + "p/" * 50_000,
]


@pytest.fixture(scope="module")
def folder(spark, talks, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(k, u, "<p>") for k, u in enumerate(URLS + URLS[:9])] + [(None, "http://net/", None)], "page_id long, url string, html string").repartition(3).write.parquet(f"{where}/pages.parquet")
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{where}/conversations.parquet")
    r = random.Random(6)
    texts = [None, "", "...", "É é one two", *[" ".join(r.choice(["to", "the", "Éa", "x" * 64, "q"]) for _ in range(40)) for _ in range(60)]]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(["to the Éa", None])], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


@pytest.mark.parametrize("name", ["op11_dialogue", "op12_resample", "op13_urls"])
@pytest.mark.parametrize("small", [False, True])
def test_sql_gives_the_same_rows(spark, folder, name, small):
    where, con = "/root/testdata/sf0.001" if small else folder, duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet{'' if small else '/*.parquet'}'")
    got = queries.QUERIES[name](spark, where)
    columns = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLE_SQL[name]})").fetchall()
    assert collections.Counter(map(tuple, got.select(*columns).collect())) == collections.Counter(expected)


def test_cascades_are_exact_and_joins_agree(spark):
    """Every key of a universe of 60 000 by bit tests; a list too large for filters goes by a join."""
    keys = spark.range(60_000).select(F.concat(F.lit("host"), "id").alias("key"), (F.col("id") % 37 == 0).alias("listed"))
    cascade = urls.build(keys)
    assert 2 <= len(cascade.levels) < 30 and sum(x.bits for x in cascade.levels) < 12 * 60_000 / 37
    assert keys.filter(cascade.listed(F.col("key")) != F.col("listed")).isEmpty()
    far = urls.build(keys, most=4)
    assert far.beyond is not None and far.mark(keys, F.col("key"), "is").filter("is <> listed").isEmpty()
    for flag in (True, False):
        same = urls.build(keys.withColumn("listed", F.lit(flag)))
        assert same.mark(keys, F.col("key"), "is").filter(F.col("is") != flag).isEmpty()
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id long, url string")
    rows = lambda **a: sorted(map(tuple, urls.filter_urls(pages, urls.rule_table(spark), **a).collect()), key=repr)
    assert rows() == rows(most=0)
    named = spark.createDataFrame([("xxx",), ("w.org",), ("xxx",), (None,)], "host string")
    got = {r.url: r.verdict for r in urls.filter_urls(pages, urls.rule_table(spark), blocked=named).collect()}
    assert got["http://xxx"] == "block" and got["http://w.org/fr/x"] == "allow" and got["http://spam-farm.org/en/"] == "allow"


def test_urls_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, host int, rule int")
    assert urls.filter_urls(pages, urls.rule_table(spark)).columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    some = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id long, url string")
    none = spark.createDataFrame([], "action string, host string, path string")
    assert {(r.rule, r.verdict) for r in urls.filter_urls(some, none).collect()} == {(None, "allow")}
