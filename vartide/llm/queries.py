"""Queries over the tables, one for each training-data operator, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vartide.llm import bpe, common, dialogue, licenses, linededup, media, neardup, oracles, packing, quality, repeats, resample, secrets, urls, warc


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens, each closed by token 2."""
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _pattern())


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return neardup.near_duplicates(common.table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, secrets and the digest of the redacted text of every document."""
    rules = secrets.forest_rules(secrets.train(secrets.labelled_findings(spark)))
    f = F.col("secret_scan")
    redacted = F.sha2(F.encode(F.coalesce(f["text"], F.lit("")), "UTF-8"), 256)
    return secrets.redact(common.table(spark, sf_dir, "documents"), rules).select("doc_id", f["n_candidates"].alias("n_candidates"), f["n_secrets"].alias("n_secrets"), f["top_score"].alias("top_score"), redacted.alias("redacted_sha256"))


def _page_of(own: Column) -> Column:
    """A document as a page: a heading, its text as a captioned figure by digest, its language, a reference to
    the empty payload (a digest that every page holds), and a last paragraph. Null parts are left out."""
    said = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(
        F.coalesce(F.concat(F.lit("<h1>"), said("source"), F.lit("</h1>")), F.lit("")),
        F.lit('<figure><img src="digest:'), own, F.lit('" alt="text"><figcaption>text of <b>document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("</b></figcaption></figure>"),
        F.coalesce(F.concat(F.lit("<p>"), said("lang")), F.lit("")),
        F.lit(f'<img data-digest="{hashlib.sha256(b"").hexdigest()}" alt="nothing"><p>end'),
    )


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as samples behind a media reference: parsed, resolved by digest, put back in order.

    The texts take part as payloads only; a document is a page that refers to its own by digest, between other
    items. Rows that repeat are one page and come back as often as they were."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", common.text_or_empty().alias("text"))
    own = F.sha2(F.encode("text", "UTF-8"), 256)
    key = F.struct("doc_id", F.xxhash64(own, "lang", "source").alias("page"))
    pages = docs.select(key.alias("page"), _page_of(own).alias("html")).groupBy("page", "html").agg(F.count("*").alias("copies"))
    sequences = common.materialize(media.parse_sequences(pages, "page"), "sequences")
    store = common.materialize(media.store_samples(docs), "op4")  # a table, so that the join can split a hot digest
    resolved = common.materialize(media.resolve(sequences, store, "page"), "resolved")
    whole = media.gather(sequences, resolved, "page").join(pages.select("page", "copies"), "page")
    first = F.filter("items", lambda x: x["item"]["kind"] == "media")[0]
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    said = F.transform("items", lambda x: F.concat_ws(":", x["item"]["kind"], blank(x["item"]["text"]), blank(x["item"]["caption"]), blank(x["payload"]["n_bytes"])))
    rows = whole.select(F.col("page.doc_id").alias("doc_id"), first.alias("own"), F.array_join(said, "|").alias("sequence"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    facts = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return rows.select("doc_id", *[F.col(f"own.payload.{c}").alias(c) for c in facts], F.col("own.at").alias("position"), F.col("own.item.caption").alias("caption"), "sequence")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of each document's whole text."""
    return licenses.scan(common.table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of each document and the verdict of the label model."""
    measured = common.materialize(quality.measure(common.table(spark, sf_dir, "documents")), "op6")
    f = [F.col(f"f.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality.judge(measured).select("doc_id", *f, "base_failed", "kept", "p_good")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive and back: record type, payload size and digest as read."""
    path = common.scratch_path(spark, "op7")
    warc.write_archives(warc.mark_duplicates(common.table(spark, sf_dir, "pages")), path)
    records = warc.reassemble(warc.read_parts(spark, path))
    return records.select(
        warc.page_id_of("record_id").alias("page_id"),
        "payload_bytes",
        F.coalesce("payload_sha1", "payload_digest").alias("payload_digest"),
        "record_type",
        warc.page_id_of("refers_to").alias("refers_to"),
        "complete",
        "n_segments",
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the multilingual ranks, and what they decode to."""
    docs, ranks = common.table(spark, sf_dir, "documents"), bpe.load_ranks(_tokenizer("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(docs, ranks, _pattern(), bpe.cache_of(docs, ranks, _pattern()))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the line runs that stand earlier: counts and the digest of what is left."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    f = F.col("line_dedup")
    return linededup.delete_repeats(docs).select("doc_id", f["n_lines"].alias("n_lines"), f["n_removed"].alias("n_removed"), f["sha256"].alias("kept_sha256"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that stand elsewhere, too."""
    return repeats.remove_repeats(common.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations after damage: what is wrong with each, the cheapest repair, and the digest of the repaired turns."""
    rows = common.table(spark, sf_dir, "conversations")
    figures, turns = dialogue.repair(dialogue.damage(rows))
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    sha = dialogue.digests(turns)
    out = every.join(figures.withColumnRenamed("conv_id", "c1"), F.col("conv_id").eqNullSafe(F.col("c1")), "left").join(sha.withColumnRenamed("conv_id", "c2"), F.col("conv_id").eqNullSafe(F.col("c2")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's words, its score, and its rank if it is drawn."""
    out = resample.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op1_pack": op1_pack, "op2_neardup": op2_neardup, "op3_secrets": op3_secrets, "op4_media": op4_media, "op5_licenses": op5_licenses, "op6_quality": op6_quality, "op7_warc": op7_warc, "op8_bpe": op8_bpe, "op9_lines": op9_lines, "op10_repeats": op10_repeats, "op11_dialogue": op11_dialogue, "op12_resample": op12_resample, "op13_urls": op13_urls}
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
