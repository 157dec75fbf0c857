"""Secret scan: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

Candidates are long runs of key characters that hold a digit, and whatever is assigned to a name such
as password or token. Features are the candidate's length, its character transitions and shares, how
much of it dictionary words cover, signs of paths, and the neighbouring words. A random forest learns
from labelled findings (by default `labelled_findings`, generated by rule; or a table of your own of at most
MAX_FINDINGS rows, the bound of the sample that is fitted). The fitted trees become one Column
expression, so that every candidate is scored inside its row: no join, no shuffle, no model broadcast.

Defined cases: null and empty texts have no candidates (null stays null); texts of any length are
scanned whole; where both patterns match at one place the assignment goes first; equal texts give equal results,
repeated rows repeat theirs; an empty table gives an empty result; extra columns pass through `redact` and are
never used, whatever their names; only one named `secret_scan` gives way to the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vartide.llm import common

MAX_FINDINGS, SEED = 20_000, 7
REDACTED = "[SECRET]"

#: Runs of key characters with a digit.
LONG = r"(?<![A-Za-z0-9+/_.\-])(?=[A-Za-z+/_.\-]*+[0-9])[A-Za-z0-9+/_\-][A-Za-z0-9+/_.\-]{14,}[A-Za-z0-9+/_\-]={0,2}"
#: What is assigned to a telling name.
ASSIGNED = r"(?<=(?:[Pp]assword|PASSWORD|passwd|pwd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Kk]ey|KEY)[\"']?\s{0,2}[:=]\s{0,2}[\"']?)[^\s\"'<>]{8,}"
NAMES = ["assword", "ASSWORD", "passwd", "pwd", "ecret", "SECRET", "oken", "TOKEN", "key", "Key", "KEY"]

#: Starts of well-known credential formats.
PREFIXES = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|ya29\.|eyJ|SG\.|npm_|pypi-|dop_v1_|hf_|shpat_)"

#: Words and word parts that occur in names, paths and prose, longest first where one holds another.
DICTIONARY = "configuration implementation application information development environment production repository collection connection controller management processing component interface parameter reference container directory exception extension framework operation service session handler manager factory builder context element example license message network package partition pattern process project provider release request resource response schema server source standard static status storage stream string struct system template version worker account address analysis archive backend browser cluster command common content control counter country current custom default delete detail device document domain download driver editor engine entity error event export feature field file filter folder format frame front function general global graph group header history image import index input instance internal item library linux list local login main master memory method model module number object office order origin output page parent parse path phase place plain player plugin point policy position prefix primary private product profile program property public python query queue random range record region remote report result return route sample scale scope script search section select sender sequence series simple single size state store style subject summary support switch table target task test text theme thread time title token tool total track train tree type unit update upload user utils value vector view web window word write the and ing tion ment ness able over under with from that this".split()

FEATURES = ["length", "transitions", "digits", "uppers", "hex_only", "distinct", "dictionary", "vowels", "path", "named", "hash_named", "assigned", "placeholder", "prefix", "repeats"]


def matches(text: Column) -> Column:
    """Struct of `values` (candidates in order) and `gaps` (the text around them, one more)."""
    named = reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in NAMES])
    both = f"(?:{ASSIGNED})|(?:{LONG})"
    of = lambda rule: F.struct(F.regexp_extract_all(text, F.lit(rule), F.lit(0)).alias("values"), F.split(text, rule, -1).alias("gaps"))
    return F.when(named, of(both)).otherwise(of(LONG))


def features(value: Column, before: Column, after: Column) -> list[Column]:
    """FEATURES as doubles; before and after are the neighbouring 40 characters."""
    n = F.greatest(F.length(value), F.lit(1))
    low, near = F.lower(value), F.lower(before)
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    left = F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        n.cast("double"),
        F.length(runs) / n,
        F.regexp_count(value, F.lit("[0-9]")) / n,
        F.regexp_count(value, F.lit("[A-Z]")) / n,
        flag(F.rlike(low, F.lit("^[0-9a-f]+$")) & F.rlike(low, F.lit("[a-f]"))),
        F.size(F.array_distinct(F.split(value, ""))) / n,
        1 - F.length(left) / n,
        F.regexp_count(low, F.lit("[aeiou]")) / n,
        (F.regexp_count(value, F.lit(r"[/.]")) + F.regexp_count(F.concat(F.substring(before, -12, 12), F.substring(after, 1, 6)), F.lit(r"/|\\|\.(?:py|js|ts|java|c|h|md|html|json|xml|yml|png|jpg)\b"))).cast("double"),
        flag(F.rlike(near, F.lit(r"token|secret|passw|pwd|api.?key|auth|credential|private|access.?key"))),
        flag(F.rlike(near, F.lit(r"sha|commit|md5|digest|checksum|uuid|guid|revision|build|version|etag"))),
        flag(F.rlike(before, F.lit("[=:]\\s{0,2}[\"']?$"))),
        flag(F.rlike(F.concat(F.substring(near, -16, 16), F.lit(" "), low), F.lit(r"example|your|xxx|test|dummy|changeme|sample|placeholder|0000|1234|abcd|redacted"))),
        flag(F.rlike(value, F.lit(PREFIXES))),
        F.regexp_count(low, F.lit(r"(.)\1")) / n,
    ]


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """value, before, after, label (1: a secret) by rule from row numbers: formats of real credentials in code,
    shells, headers and addresses on one side; identifiers, paths, hosts, digests, dates, placeholders and plain
    numbers on the other."""
    h = lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{k}")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(h(1))), "[+/=]", "k")
    pick = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    word = lambda k: pick(k, DICTIONARY)
    digits = lambda k, n: F.lpad(F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(10**n)).cast("string"), n, "7")
    prose = lambda k: F.concat_ws(" ", word(k), word(k + 1), word(k + 2))
    names = pick(50, ["token", "api_key", "secret", "password", "auth_token", "client_secret", "access_key", "private_key"])
    assign = F.concat(prose(20), F.lit(" "), names, pick(51, [" = \"", ": ", "=", ": '", " = '", ":\"", " "]))
    plain = F.concat(prose(24), pick(52, [" ", " in ", ": ", " = ", " (", " \""]))
    digest = F.concat(prose(28), F.lit(" "), pick(53, ["commit ", "sha256:", "md5 ", "checksum: ", "digest=", "etag: \"", "revision ", "uuid "]))
    camel = F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), digits(4, 2))
    snake = F.concat_ws("_", word(5), word(6), word(7), digits(8, 3))
    path = F.concat(F.lit("/"), word(9), F.lit("/"), word(10), F.lit("/"), word(11), F.lit("-"), digits(12, 2), F.lit("."), pick(54, ["py", "js", "html", "json", "log"]))
    upper = lambda c: F.upper(c)
    url = F.concat(prose(36), F.lit(" https://"), word(37), F.lit("."), word(38), pick(57, [".com/", ".org/", ".io/v2/", ".net/api/"]))
    query = F.concat(url, word(39), pick(58, ["?token=", "?api_key=", "?access_token=", "?sig="]))
    env = F.concat(F.lit("export "), upper(word(40)), pick(59, ["_TOKEN=", "_SECRET=", "_PASSWORD=", "_API_KEY=", "_ACCESS_KEY=\""]))
    header = F.concat(prose(41), pick(60, [" Authorization: Bearer ", " X-Api-Key: ", " authorization: token ", " Cookie: session_token="]))
    urlsafe = F.translate(F.base64(F.unhex(h(4))), "+/=", "-_0")
    mixed = F.concat(F.substring(base64, 3, 7), pick(61, ["!", "$", "%", "_", "-", "#"]), F.substring(base64, 12, 5), digits(42, 2))
    host = F.concat(pick(62, ["mail", "www", "node", "db-primary-", "cdn", "ns"]), digits(43, 1), F.lit("."), word(44), pick(63, [".com", ".example.com", ".org", ".internal.net"]))
    address = F.concat(prose(45), F.lit("."), digits(46, 2), F.lit("@"))
    date = F.concat_ws("-", F.concat(F.lit("20"), digits(47, 2)), F.lit("0").cast("string"), digits(48, 2))
    positive = [
        (F.substring(h(1), 1, 40), assign), (F.substring(h(1), 1, 32), assign), (F.substring(base64, 1, 40), assign), (F.substring(base64, 1, 24), assign),
        (F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(base64, 1, 16), "lo", "QR"))), plain), (F.concat(F.lit("ghp_"), F.substring(base64, 1, 36)), plain),
        (F.concat(F.lit("sk-"), base64), plain), (F.concat(F.lit("AIza"), F.substring(base64, 1, 35)), plain), (F.concat(F.lit("xoxb-"), digits(13, 11), F.lit("-"), F.substring(base64, 1, 24)), assign),
        (F.concat(F.initcap(F.substring(word(14), 1, 5)), F.substring(base64, 1, 6), digits(15, 3)), assign),
        (upper(F.substring(h(5), 1, 40)), upper(assign)), (F.substring(h(5), 1, 64), env), (F.substring(urlsafe, 1, 32), query), (F.substring(urlsafe, 1, 43), header),
        (F.concat(F.lit("eyJ"), F.substring(urlsafe, 1, 20), F.lit("."), F.substring(base64, 1, 30)), header), (mixed, assign), (mixed, env),
    ]
    negative = [
        (camel, plain), (snake, plain), (path, plain), (F.substring(h(2), 1, 40), digest), (h(2), digest), (digits(16, 16), plain), (F.concat(digits(17, 9), digits(18, 9)), plain),
        (F.concat(pick(55, ["your_", "example_", "test_", "dummy_", "changeme_"]), word(19), F.lit("_key_1234")), assign), (F.concat(F.repeat(pick(56, ["x", "0", "a1"]), 12), F.lit("0")), assign),
        (F.concat_ws("-", F.substring(h(3), 1, 8), F.substring(h(3), 9, 4), F.substring(h(3), 13, 4), F.substring(h(3), 17, 4), F.substring(h(3), 21, 12)), digest), (F.concat_ws("-", digits(31, 4), digits(32, 2), F.lit("01T00"), word(33), word(34)), plain), (snake, assign), (path, assign),
        (host, address), (host, url), (F.concat(word(64), F.lit("/"), word(65), F.lit("-"), digits(66, 3)), url), (F.concat(word(67), F.lit("."), word(68), F.lit("_"), word(69), digits(70, 2)), assign),
        (F.concat(date, F.lit("_"), word(71), F.lit(".csv.gz")), plain), (F.concat_ws(".", word(72), digits(73, 2), digits(74, 1), F.lit("rc1"), word(75)), plain), (F.concat(F.lit("DE"), digits(76, 15), digits(77, 5)), plain),
        (F.concat(F.lit("os.environ/"), word(78), F.lit("_"), word(79), digits(80, 1)), assign),
    ]
    every = [F.struct(v.alias("value"), b.alias("before"), F.lit(1.0).alias("label")) for v, b in positive] + [F.struct(v.alias("value"), b.alias("before"), F.lit(0.0).alias("label")) for v, b in negative]
    one = F.element_at(F.array(*every), (F.pmod(F.col("id"), F.lit(len(every))) + 1).cast("int"))
    found = spark.range(0, rows, 1, 2).select("id", one.alias("f"))
    return found.select("id", "f.value", "f.before", F.concat(F.lit("\" "), prose(60)).alias("after"), "f.label")


def train(findings: DataFrame, trees: int = 20, depth: int = 6):
    """A random forest over the first MAX_FINDINGS labelled findings by value; more are never fitted."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.orderBy("value", "before").limit(MAX_FINDINGS)
    named = [c.cast("double").alias(n) for c, n in zip(features(F.col("value"), F.col("before"), F.col("after")), FEATURES, strict=True)]
    data = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows.select("label", *named)).select("label", "x")
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED).fit(data)


def forest_rules(model) -> list:
    """The trees as nested (feature, threshold, left, right) or the share of secrets at a leaf."""

    def walk(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return round(node.impurityStats().prob(1.0), 6)
        split = node.split()
        return (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()))

    return [walk(t._java_obj.rootNode()) for t in model.trees]


def score(rules: list, x: Column) -> Column:
    """The forest's mean vote for a secret over the feature array x."""

    def walk(node):
        if not isinstance(node, tuple):
            return F.lit(float(node))
        k, at, low, high = node
        return F.when(F.get(x, F.lit(k)) <= at, walk(low)).otherwise(walk(high))

    return reduce(lambda a, b: a + b, [walk(t) for t in rules]) / len(rules)


def scan(text: Column, rules: list, threshold: float = 0.5) -> Column:
    """Struct of n_candidates, n_secrets, top_score and the redacted text."""

    def of(m: Column) -> Column:
        def scored(x: Column, i: Column) -> Column:
            before, after = F.get(m["gaps"], i), F.get(m["gaps"], i + 1)
            return common.let(F.array(*features(x, F.substring(before, -40, 40), F.substring(after, 1, 40))), lambda f: score(rules, f))

        def result(scores: Column) -> Column:
            secret = F.filter(scores, lambda s: s >= threshold)
            said = F.transform(m["gaps"], lambda g, i: F.concat(g, F.when(F.get(scores, i) >= threshold, F.lit(REDACTED)).otherwise(F.coalesce(F.get(m["values"], i), F.lit("")))))
            return F.struct(
                F.size(scores).cast("long").alias("n_candidates"), F.size(secret).cast("long").alias("n_secrets"),
                F.coalesce(F.array_max(scores), F.lit(0.0)).alias("top_score"),
                F.when(F.size(secret) > 0, F.array_join(said, "")).otherwise(text).alias("text"),
            )

        return common.let(F.transform(m["values"], scored), result)

    return common.let(matches(F.coalesce(text, F.lit(""))), of)


def redact(docs: DataFrame, rules: list) -> DataFrame:
    """docs with a struct `secret_scan`; its `text` is the redacted text (null stays null)."""
    return docs.withColumn("secret_scan", scan(F.col("text"), rules))
