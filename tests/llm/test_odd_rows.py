"""Every operator and stage on extra columns with clashing names, a 2 MB text, ties, repeated rows and doc_ids."""

import collections
import hashlib
import math

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from pyspark.sql import functions as F  # noqa: E402
from test_operators import lines_by_force, quality_by_force, repeats_by_force, words  # noqa: E402

from vartide.llm import bpe, common, licenses, linededup, media, neardup, packing, quality, repeats, secrets, stages, warc  # noqa: E402

CLASH = "runs line_dedup secret_scan _nth nth _doc doc _key key _own own text_key component_id kept n_shingles set_key rep band label f pattern base_failed p_good gram region spans found word ids decoded piece length bucket rank html digest item spaced n_words base more payload record".split()


@pytest.fixture(scope="module")
def rows():
    long = "\n".join(" ".join(words(40, k, 90_000)) for k in range(9000))
    assert len(long.encode()) > 2_000_000
    a, b = " ".join(words(80, 71)), " ".join(words(80, 72))
    return [(1, a), (1, b), (1, a), (2, long), (3, a + "\n" + b), (4, a + "\n" + b), (None, b), (None, None), (5, ""), (6, None), (7, "tie tie\ntie tie\ntie tie"), (8, long[: len(long) // 2])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    return common.materialize(made.withColumns({c: F.lit(f"my {c}") for c in CLASH}), "docs")


def test_operators_take_them(spark, docs, rows):
    n = len(rows)
    texts = [t or "" for _, t in rows]
    pieces = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert sum(r.piece == 0 for r in pieces) == n and max(r.length for r in pieces) <= 1024
    near = collections.Counter((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs.filter("doc_id <> 1 or doc_id is null")).collect())
    assert sum(near.values()) == n - 3 and near[(4, 3)] == 1 and near[(None, None)] == 2
    rules = secrets.forest_rules(secrets.train(secrets.labelled_findings(spark, 600), trees=3))
    assert secrets.redact(docs, rules).filter("secret_scan.n_candidates >= 0 and runs = 'my runs'").count() == n
    store = {r.digest: r for r in media.store_samples(docs).collect()}
    assert set(store) == {hashlib.sha256(t.encode()).hexdigest() for t in texts}
    assert all(store[hashlib.sha256(t.encode()).hexdigest()].n_bytes == len(t.encode()) for t in texts)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<p>"), "text").alias("html"), "item", "digest", "found")
    said = collections.Counter(tuple(x.text for x in r[1]) for r in media.parse_sequences(pages).collect())
    assert said == collections.Counter((" ".join(t.split()),) if t.split() else () for t in texts)
    assert licenses.scan(docs).count() == n
    for r in quality.judge(common.materialize(quality.measure(docs), "m")).collect():
        assert r.f.n_words in {quality_by_force(t)[0] for i, t in rows if i == r.doc_id}
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    got = collections.Counter((r.doc_id, r.decoded_sha256) for r in bpe.encode(docs, ranks, P.PATTERN, bpe.cache_of(docs, ranks, P.PATTERN, 99)).collect())
    assert got == collections.Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_warc_takes_them(spark, docs, rows, monkeypatch):
    """Long pages, clashing columns; no file above the bound."""
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "payload", "record", "digest")
    path = common.scratch_path(spark, "warc")
    warc.write_archives(warc.mark_duplicates(pages), path, file_bytes=100_000)
    sizes = [len(b) for (b,) in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content").collect()]
    import gzip

    files = [gzip.decompress(b) for (b,) in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content").collect()]
    assert len(sizes) > 20 and max(map(len, files)) < 100_000 + 40_000
    got = collections.Counter((r.payload_bytes, r.payload_sha1 or r.payload_digest) for r in warc.reassemble(warc.read_parts(spark, path)).collect())
    assert got == collections.Counter((len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest()) for _, t in rows)


def test_captions_and_texts_are_kept():
    said = lambda html: [(x["kind"], x["text"] or x["source"], x["caption"]) for x in media.parse_html(html)]
    assert said("<p>a<figcaption>abc<p>def") == [("text", "a", None), ("text", "abc", None), ("text", "def", None)]
    assert said("<figure><figcaption>no image</figcaption></figure>b") == [("text", "no image", None), ("text", "b", None)]
    assert said('<figure><img src="digest:x"><figcaption>cap</figure>after') == [("media", "digest:x", "cap"), ("text", "after", None)]
    assert said('<img src="http://h/i.png" alt="i">z') == [("media", "http://h/i.png", "i"), ("text", "z", None)]
    assert said('<figure><img src="digest:x"><figcaption>cap <p>two</p></figcaption>') == [("media", "digest:x", "cap two")]


def test_lines_and_repeats_take_them(docs, rows):
    few = [(i, t) for i, t in rows if i not in (None, 1)]
    got = {r.doc_id: r for r in linededup.delete_repeats(docs.filter("doc_id <> 1")).collect()}
    for i, (n, gone, left) in lines_by_force(few).items():
        assert (got[i].line_dedup.n_lines, got[i].line_dedup.n_removed, got[i].text or "") == (n, gone, left) and got[i].runs == "my runs"
    short = [(i, (t or "")[:3000]) for i, t in rows]
    cut = docs.withColumn("text", F.substring("text", 1, 3000))
    found = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(cut).collect())
    assert found == repeats_by_force([(i, t.encode()) for i, t in short], 200)
    whole = {r.doc_id: r for r in repeats.remove_repeats(docs.filter("doc_id in (2, 8)")).collect()}
    assert whole[8].n_removed == whole[8].n_bytes == whole[2].n_removed


def test_stages_keep_every_column(spark, docs):
    for stage in (stages.quality_rules, stages.line_dedup, stages.near_dedup, stages.secret_scan):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept = out.collect()
        assert kept and all(r[c] == f"my {c}" for r in kept for c in CLASH)
    assert stages.pack(spark, docs, "").count() >= docs.count()


def test_label_model_against_plain_expectation_maximisation():
    """The fit over counts of patterns gives what the same steps over single documents give."""
    import random

    r, rules = random.Random(9), 3
    patterns = [[r.choice([0, 1, 2]) if r.random() < 0.3 else (2 if k % 5 else 0) for _ in range(rules)] for k in range(60)]
    codes = [sum(v * 3**j for j, v in enumerate(p)) for p in patterns]
    model = quality.LabelModel(rules).fit(collections.Counter(codes), 20)
    start = {1: (0.02, 0.18, 0.8), 0: (0.3, 0.2, 0.5)}
    good, p = 0.8, {c: [list(start[c]) for _ in range(rules)] for c in (0, 1)}
    post = lambda v: 1 / (1 + math.exp(-(math.log(good / (1 - good)) + sum(math.log(p[1][j][x] / p[0][j][x]) for j, x in enumerate(v)))))
    for _ in range(20):
        q = [post(v) for v in patterns]
        mass = {c: [[5 * x + sum(w for w, v in zip(([1 - y for y in q], q)[c], patterns, strict=True) if v[j] == k) for k, x in enumerate(start[c])] for j in range(rules)] for c in (0, 1)}
        good = (8 + sum(q)) / (10 + len(q))
        p = {c: [[x / sum(m) for x in m] for m in mass[c]] for c in (0, 1)}
    assert all(abs(model.posterior(c) - post(v)) < 1e-9 for c, v in zip(codes, patterns, strict=True))


def test_groups_of_a_large_bin_are_its_windows(spark, monkeypatch):
    """With bins of more than two classes dealt by windows, every repeated window is still covered by groups."""
    monkeypatch.setattr(repeats, "BIN", 2)
    passage = " ".join(words(60, 21))
    rows = [(k, " ".join(words(30, 30 + k)) + passage + " ".join(words(30, 60 + k))) for k in range(5)]
    raw = {k: t.encode() for k, t in rows}
    groups = collections.defaultdict(set)
    for r in repeats.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        groups[r.group_id].add((r.doc_id, r.start, raw[r.doc_id][r.start : r.start + r.length]))
    assert groups and all(len({x for *_, x in g}) == 1 and len(g) > 1 for g in groups.values())
    covered = {(d, k) for g in groups.values() for d, at, x in g for k in range(at, at + len(x) - 199)}
    at = collections.Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    assert covered == {(d, k) for d, b in raw.items() for k in range(len(b) - 199) if at[b[k : k + 200]] > 1}
