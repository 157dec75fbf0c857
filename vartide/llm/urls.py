"""URL filters: rules of host and path, and a list of hosts, met exactly through cascades of Bloom filters.

1. Every url gives keys: for each number of labels and each length of path that the rules have, the end of
   its host with that many labels and the start of its path of that length; and its host.
2. A cascade (`build`) is a list of Bloom filters. The first holds the listed keys among the keys of all urls; the
   second those keys that are not listed and still pass the first; the third the listed ones that pass the
   second; and so on, until nothing passes wrongly. The first filter that a key fails says what it is: exact for
   every key of the corpus, a few bits for each listed key.
3. Rows are judged by bit tests alone (`listed`), without a join: the longest listed key is the rule, and
   where none fits, the list of hosts decides.

A filter is an array of 64-bit words, computed by Spark's partial aggregates and put into the plan as a literal.
Lists whose filters would pass MAX_WORDS words are met by a join instead, with the same rows.

Defined cases: null urls and urls without :// have an empty host and path, no rule, and are allowed; hosts may have any
number of labels and urls any length, as only the parts that rules can name are cut out; rows that repeat a
page are judged each; of two rules for one host and path, block counts; an empty table or empty rules give a result;
of extra columns those that are called like results are replaced, the others ignored by the query.
"""

from __future__ import annotations

import math
import operator
import string
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vartide.llm import common

#: Words (8 bytes each) of all filters of one cascade: 2 MB, enough for a million listed keys and more.
MAX_WORDS = 1 << 18

#: The contract's rules: action, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Parts of host labels (between hyphens) that put a host on the list.
BLOCKED_PARTS = ["ad", "ads", "adult", "bet", "bets", "betting", "casino", "gambling", "malware", "phishing", "pills", "poker", "porn", "sex", "spam", "track", "tracker", "tracking", "viagra", "warez", "xxx"]


def host_of(url: Column) -> Column:
    """What stands after the first :// up to a slash, question mark, hash or the end; A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def blocked_host(host: Column, parts: list[str] = BLOCKED_PARTS) -> Column:
    """Whether a label of the host has one of the parts."""
    return host.rlike(rf"(^|[.-])({'|'.join(parts)})([.-]|\z)")


@dataclass
class Level:
    """One Bloom filter: its array of words, its bits, hash functions and salt."""

    words: Column
    bits: int
    hashes: int
    salt: int

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.salt), F.lit(i), key), F.lit(self.bits)) for i in range(self.hashes)]

    def has(self, key: Column) -> Column:
        bit = lambda words, p: F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1
        return common.let(self.words, lambda words: reduce(operator.and_, [bit(words, p) for p in self.places(key)]))


@dataclass
class Cascade:
    """Levels of one list; `beyond` are the listed keys where the filters would be too large."""

    levels: list[Level] = field(default_factory=list)
    beyond: DataFrame | None = None

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed, by bit tests."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out

    def mark(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """rows with the boolean column `name`."""
        if self.beyond is None:
            return rows.withColumn(name, F.coalesce(self.listed(key), F.lit(False)))
        k = common.unused("listed_key", rows.columns)
        there = self.beyond.select(F.col("key").alias(k), F.lit(True).alias(name))
        return rows.join(there, key == F.col(k), "left").drop(k).withColumn(name, F.coalesce(name, F.lit(False)))


def _level(keys: DataFrame, n: int, rate: float, salt: int) -> tuple[Level, int]:
    """The filter of n keys that passes others at `rate`, and its number of words."""
    words = max(1, math.ceil(n * math.log2(1 / rate) / math.log(2) / 64))
    level = Level(F.lit(None), 64 * words, max(1, round(math.log2(1 / rate))), salt)
    places = keys.select(F.explode(F.array(*level.places(F.col("key")))).alias("p"))
    some = places.select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bits"))
    every = some.unionByName(keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
    table = common.materialize(every.groupBy("word").agg(F.bit_or("bits").alias("bits")), "bloom")
    bits = [str(r.bits) for r in table.sort("word").select("bits").collect()]  # at most MAX_WORDS
    level.words = F.split(F.lit(",".join(bits)), ",").cast("array<bigint>")  # folded into one literal
    return level, words


def build(keys: DataFrame, most: int = MAX_WORDS) -> Cascade:
    """The cascade of keys (key, listed), which are distinct and all keys that will ever be asked for."""
    keys = common.materialize(keys.select("key", "listed"), "universe")
    sizes = keys.agg(F.count_if(F.col("listed")), F.count_if(~F.col("listed"))).first()
    here, there, size = keys.filter("listed").select("key"), keys.filter("not listed").select("key"), list(sizes)
    out, used = Cascade(), 0
    while size[0]:
        rate = min(0.5, size[0] / (math.sqrt(2) * max(size[1], 1))) if not out.levels else 0.5
        if used + size[0] * math.log2(1 / rate) / math.log(2) / 64 > most:
            return Cascade(beyond=keys.filter("listed").select("key"))
        level, words = _level(here, size[0], rate, len(out.levels))
        used += words
        out.levels.append(level)
        passed = common.materialize(there.filter(level.has(F.col("key"))), "passed")
        here, there, size = passed, here, [passed.count(), size[0]]
    return out


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")


def _candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> list[Column]:
    """The keys of an url that a rule can have; null where it has too few labels or too short a path."""
    out = []
    for n in labels:
        end = F.substring_index(host, ".", -n)
        enough = F.regexp_count(host, F.lit(r"\.")) >= n - 1
        for k in lengths:
            out.append(F.when(enough & (host != "") & (F.length(path) >= k), F.concat(end, F.substring(path, 1, k))))
    return out


def filter_urls(pages: DataFrame, rules: DataFrame, blocked=blocked_host, url: str = "url", most: int = MAX_WORDS) -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: action (block or allow), host, path. blocked: a function of a Column of hosts, or a table with a column
    `host`, that says which hosts are on the list."""
    names = ("host", "path", "rule", "verdict")
    rows = pages.drop(*[c for c in pages.columns if c.lower() in names]).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rules = rules.select(F.concat("host", "path").alias("key"), "action", (F.regexp_count("host", F.lit(r"\.")) + 1).alias("labels"), F.length("path").alias("length"))
    rules = common.materialize(rules.filter("key is not null").groupBy("key").agg(F.max("action").alias("action"), F.first("labels").alias("labels"), F.first("length").alias("length")), "rules")
    shape = rules.agg(F.collect_set("labels"), F.collect_set("length")).first()
    candidates = _candidates(F.col("host"), F.col("path"), sorted(shape[0]), sorted(shape[1]))

    met = rows.select("host", *[c.alias(f"k{i}") for i, c in enumerate(candidates)]).distinct()
    asked = met.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("host").alias("key")), *[F.struct(F.lit(1).alias("kind"), F.col(f"k{i}").alias("key")) for i in range(len(candidates))])).alias("x"))
    keys = common.materialize(asked.select("x.kind", "x.key").filter("key is not null").distinct(), "keys")
    known = common.materialize(keys.filter("kind = 1").join(rules, "key", "left").select("key", "action"), "known")
    any_rule = build(known.select("key", F.col("action").isNotNull().alias("listed")), most)
    allowing = build(known.filter("action is not null").select("key", (F.col("action") == "allow").alias("listed")), most)
    hosts = keys.filter("kind = 0").select("key")
    hosts = hosts.withColumn("listed", blocked(F.col("key"))) if callable(blocked) else hosts.join(blocked.select(F.col("host").alias("key"), F.lit(True).alias("listed")).distinct(), "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    on_list = build(hosts, most)

    spare, held = [], []
    for c in candidates:
        key, hit = (common.unused(x, [*rows.columns, *spare]) for x in (f"key{len(held)}", f"hit{len(held)}"))
        rows = any_rule.mark(rows.withColumn(key, c), F.col(key), hit)
        spare += [key, hit]
        held.append(F.when(F.col(hit) & F.col(key).isNotNull(), F.struct(F.length(key).alias("length"), (-F.instr(key, "/")).alias("host"), F.col(key).alias("key"))))
    longest = F.greatest(*held) if len(held) > 1 else held[0] if held else F.lit(None).cast("struct<length:int,host:int,key:string>")
    rows = rows.withColumn("rule", longest["key"])
    let, bad = (common.unused(x, rows.columns) for x in ("let", "bad"))
    rows = on_list.mark(allowing.mark(rows, F.col("rule"), let), F.col("host"), bad)
    passes = F.when(F.col("rule").isNotNull(), F.col(let)).otherwise(~F.col(bad))
    return rows.withColumn("verdict", F.when(passes, F.lit("allow")).otherwise(F.lit("block"))).drop(*spare, let, bad)
