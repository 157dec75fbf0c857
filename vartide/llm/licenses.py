"""License scan by ordered signature rules, in DataFrame functions only.

Texts become words (ASCII lower case) joined by single spaces, so that every rule is a regex over
words and a match's place is a word number. A keyword prefilter decides which rules a text meets at
all: a few plain terms over the whole text first, then each rule's own keyword. A detection whose interval
lies inside one of higher priority, or inside a longer one of the same, is suppressed; one of higher priority
stays, also inside a longer one. What is left gives labels and a score.

Base phrases (the contract's) are counted at all their places, whatever the rules say.

Defined cases: null and empty texts have no words, no labels ('') and score 0; repeated rows repeat
their result; of equal intervals of one priority the label that sorts first stays; texts of any length are
scanned whole, in time linear in their matches but for a small power; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vartide.llm import common

#: Characters that stand between words: ASCII without letters and digits (letters are lower-cased before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed values of the contract: phrase -> label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Families of licenses: label, keyword that a text must hold, regex of the name, versions.
FAMILIES = [
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", "1 2 3"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[sc]e", "2 2.1 3"),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[sc]e", "2"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", "1 3"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", "1.1 1.2 1.3"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", "1.0 1.1 2.0 2"),
    ("mit", "mit", r"(?:the )?mit (?:x11 )?licen[sc]e", ""),
    ("bsd", "bsd", r"(?:[234] clause |new |modified |simplified |revised |original )?bsd licen[sc]e", ""),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", "1.0 1.1 2.0"),
    ("epl", "eclipse", r"eclipse public licen[sc]e", "1.0 2.0"),
    ("edl", "eclipse distribution", r"eclipse distribution licen[sc]e", "1.0"),
    ("cddl", "common development", r"common development and distribution licen[sc]e", "1.0 1.1"),
    ("cpl", "common public", r"common public licen[sc]e", "1.0"),
    ("eupl", "european union", r"european union public licen[sc]e", "1.0 1.1 1.2"),
    ("isc", "isc", r"isc licen[sc]e", ""),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", ""),
    ("boost", "boost", r"boost software licen[sc]e", "1.0"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[sc]e", "1.0 2.0"),
    ("python", "python", r"python (?:software foundation )?licen[sc]e", "2"),
    ("php", "php", r"php licen[sc]e", "3.0 3.01"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ""),
    ("wtfpl", "want to public", r"do what the fuck you want to public licen[sc]e", "2"),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", "1.0 1.1"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", ""),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e", ""),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", ""),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", ""),
    ("osl", "open software", r"open software licen[sc]e", "1.0 2.0 2.1 3.0"),
    ("afl", "academic free", r"academic free licen[sc]e", "2.0 2.1 3.0"),
    ("sspl", "server side", r"server side public licen[sc]e", "1"),
    ("busl", "business source", r"business source licen[sc]e", "1.1"),
    ("elastic", "elastic", r"elastic licen[sc]e", "2.0"),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database licen[sc]e", "1.0"),
    ("cecill", "cecill", r"cecill(?: [abc])?(?: free software)? licen[sc]e", "1 2 2.1"),
    ("cc0", "cc0", r"(?:creative commons )?cc0", "1.0"),
    ("cc-by-nc-nd", "nc nd", r"cc by nc nd", "2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "nc sa", r"cc by nc sa", "2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "by nc", r"cc by nc", "2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "by nd", r"cc by nd", "2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "by sa", r"cc by sa", "2.0 2.5 3.0 4.0"),
    ("cc-by", "cc by", r"cc by", "2.0 2.5 3.0 4.0"),
    ("cc-by", "creative commons", r"creative commons attribution(?: licen[sc]e)?", "2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "share", r"creative commons attribution share ?alike", "2.0 3.0 4.0"),
    ("cc-by-nc", "attribution non", r"creative commons attribution non ?commercial", "2.0 3.0 4.0"),
]

#: Names in SPDX tags: label -> words of the tag's start.
TAGS = ["agpl", "apache", "artistic", "bsd", "bsl", "cc by nc nd", "cc by nc sa", "cc by nc", "cc by nd", "cc by sa", "cc by", "cc0", "cddl", "cecill", "epl", "eupl", "gfdl", "gpl", "isc", "lgpl", "mit", "mpl", "ncsa", "ofl", "osl", "postgresql", "python", "unlicense", "wtfpl", "zlib"]

#: Sentences of license texts and notices: label, keyword, regex.
SENTENCES = [
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "permission notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", "without restriction", r"to deal in the software without restriction"),
    ("mit", "merge publish", r"to use copy modify merge publish distribute sublicen[sc]e and or sell copies"),
    ("isc", "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("hpnd", "permission to use", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "endorse or promote", r"may be used to endorse or promote products derived from this software"),
    ("bsd", "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("bsd", "provided by the", r"this software is provided by the (?:copyright holders?|authors?|regents)(?: and contributors)? as is"),
    ("apache", "in compliance with", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache", "agreed to in writing", r"unless required by applicable law or agreed to in writing"),
    ("apache", "obtain a copy", r"you may obtain a copy of the licen[sc]e at"),
    ("apache", "as is", r"on an as is basis without warranties or conditions of any kind"),
    ("apache", "software foundation", r"licen[sc]ed to the apache software foundation"),
    ("apache", "terms and conditions", r"terms and conditions for use reproduction and distribution"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "source distribution", r"this notice may not be removed or altered from any source distribution"),
    ("boost", "machine executable", r"unless such copies or derivative works are solely in the form of machine executable object code"),
    ("boost", "person or organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it"),
    ("gpl", "without any warranty", r"but without any warranty without even the implied warranty of merchantability"),
    ("gpl", "any later version", r"either version (?:2|3) of the licen[sc]e or at your option any later version"),
    ("gpl", "should have received", r"you should have received a copy of the gnu general public licen[sc]e"),
    ("gpl", "under the terms", r"under the terms of the gnu general public licen[sc]e"),
    ("lgpl", "free software", r"this library is free software you can redistribute it and or modify it"),
    ("lgpl", "should have received", r"you should have received a copy of the gnu lesser general public licen[sc]e"),
    ("lgpl", "under the terms", r"under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", "should have received", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("agpl", "under the terms", r"under the terms of the gnu affero general public licen[sc]e"),
    ("gfdl", "permission is granted", r"permission is granted to copy distribute and or modify this document"),
    ("gfdl", "invariant sections", r"with no invariant sections"),
    ("mpl", "source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl", "contents of this file", r"the contents of this file are subject to the mozilla public licen[sc]e"),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("cddl", "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("eupl", "eupl", r"licen[sc]ed under the eupl"),
    ("artistic", "perl itself", r"(?:same terms|terms) as perl itself"),
    ("ofl", "reserved font name", r"with reserved font names?"),
    ("json", "not evil", r"shall be used for good not evil"),
    ("beerware", "me a beer", r"you can buy me a beer in return"),
    ("wtfpl", "you want to", r"you just do what the fuck you want to"),
    ("unlicense", "public domain", r"free and unencumbered software released into the public domain"),
    ("unlicense", "free to copy", r"anyone is free to copy modify publish use compile sell or distribute"),
    ("cc0", "extent possible", r"to the extent possible under law"),
    ("cc0", "copyright and related", r"all copyright and related or neighbou?ring rights"),
    ("creative-commons", "creative commons", r"this work is licen[sc]ed under (?:a|the) creative commons"),
    ("public-domain", "public domain", r"(?:is|are|placed|dedicated|released) (?:in|in|to|into) the public domain"),
    ("public-domain", "no rights", r"no rights reserved"),
    ("proprietary", "all rights", r"all rights reserved"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution)"),
    ("proprietary", "internal use", r"for internal use only"),
    ("proprietary", "evaluation purposes", r"for evaluation purposes only"),
    ("proprietary", "prior written", r"without (?:the )?(?:express )?prior written (?:permission|consent)"),
    ("proprietary", "end user", r"end user licen[sc]e agreement"),
    ("non-commercial", "commercial", r"for non ?commercial (?:use|purposes)"),
    ("warranty-disclaimer", "as is", r"provided as is without warranty"),
    ("warranty-disclaimer", "copyright holders", r"in no event shall the (?:authors or )?copyright holders be liable"),
    ("see-license-file", "file", r"see (?:the )?(?:accompanying )?licen[sc]e file"),
    ("see-license-file", "file", r"licen[sc]e (?:can be found|that can be found|found) in the licen[sc]e file"),
]

#: Addresses of license texts, as words: label, keyword, regex.
ADDRESSES = [
    ("mit", "opensource org", r"opensource org licen[sc]es? mit"),
    ("bsd", "opensource org", r"opensource org licen[sc]es? bsd"),
    ("isc", "opensource org", r"opensource org licen[sc]es? isc"),
    ("zlib", "opensource org", r"opensource org licen[sc]es? zlib"),
    ("artistic", "opensource org", r"opensource org licen[sc]es? artistic"),
    ("apache", "apache org", r"apache org licen[sc]es licen[sc]e (?:1 1|2 0)"),
    ("gpl", "gnu org", r"gnu org licen[sc]es (?:old licen[sc]es )?gpl"),
    ("lgpl", "gnu org", r"gnu org licen[sc]es (?:old licen[sc]es )?lgpl"),
    ("agpl", "gnu org", r"gnu org licen[sc]es agpl"),
    ("gfdl", "gnu org", r"gnu org licen[sc]es fdl"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licen[sc]es by nc nd"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licen[sc]es by nc sa"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licen[sc]es by nc"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licen[sc]es by nd"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licen[sc]es by sa"),
    ("cc-by", "creativecommons", r"creativecommons org licen[sc]es by [1-4] [05]"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero"),
    ("mpl", "mozilla org", r"mozilla org (?:en us )?mpl"),
    ("epl", "eclipse org", r"eclipse org legal epl"),
    ("boost", "boost org", r"boost org licen[sc]e 1 0"),
    ("ofl", "sil org", r"sil org ofl"),
    ("unlicense", "unlicense org", r"unlicense org"),
]


def _rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, regex, priority, confidence): the more specific a signature, the higher its priority."""
    out = []
    for label, keyword, name, versions in FAMILIES:
        for v in versions.split():
            number = v.replace(".", " ")
            out.append((label, keyword, rf"{name} (?:version |v ?)?{number}", 90, 0.99))
            out.append((label, keyword, rf"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name} (?:version |v ?)?{number}", 95, 1.0))
        out.append((label, keyword, rf"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name}", 80, 0.97))
        out.append((label, keyword, name, 60, 0.9))
    for tag in TAGS:
        out.append((tag.replace(" ", "-"), "spdx", rf"spdx licen[sc]e identifier {tag}(?: [0-9]+)*(?: only| or later)?", 100, 1.0))
    out += [(label, keyword, rule, 70, 0.8) for label, keyword, rule in SENTENCES]
    out += [(label, keyword, rule, 98, 1.0) for label, keyword, rule in ADDRESSES]
    return out


RULES = _rules()
#: Priorities from high to low; a rule's level is its place here.
LEVELS = sorted({priority for *_, priority, _ in RULES}, reverse=True)


def words_of(text: str = "text") -> Column:
    """The words joined by single spaces, with a space at either end; A-Z in lower case, other letters as they are."""
    bare = F.regexp_replace(F.translate(common.text_or_empty(text), string.ascii_uppercase, string.ascii_lowercase), BETWEEN, " ")
    return F.concat(F.lit(" "), F.trim(bare), F.lit(" "))


def _spaces(x: Column) -> Column:
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))


def count_words(spaced: Column) -> Column:
    return F.when(F.octet_length(spaced) <= 2, 0).otherwise(_spaces(spaced) - 1)


def _certain(rule: str) -> str:
    """The rule without its groups, which may be absent or stand for one of several texts."""
    return re.sub(r"\(\?:[^()]*\)\??", "|", rule)


def gate_terms() -> list[str]:
    """Few plain terms of which every match of any rule holds one: the prefilter over whole texts. A shared
    term stands for a rule's keyword only where each match of the rule holds it."""
    terms = {next((t for t in ("licen", "cc by", "creative commons") if t in _certain(rule)), keyword) for _, keyword, rule, *_ in RULES}
    return sorted(t for t in terms if not any(o != t and o in t for o in terms))


def base_places(spaced: Column, n_words: Column) -> Column:
    """Struct of n_base, first_word, last_word and the base labels, from the words around each phrase."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        hit = F.contains(spaced, F.lit(f" {phrase} "))
        before = F.substring_index(spaced, f" {phrase} ", 1)  # a space before each word, none at its end
        after = F.substring_index(spaced, f" {phrase} ", -1)  # a space behind each word
        counts.append(F.when(hit, F.regexp_count(spaced, F.lit(f" {phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(hit, _spaces(before)))
        lasts.append(F.when(hit, n_words - _spaces(after) - len(phrase.split())))
        labels.append(F.when(hit, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return F.struct(
        total.cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("labels"),
    )


def _literal(rules: list[tuple[str, str, str, int, float]]) -> Column:
    import json

    rows = json.dumps([{"label": a, "keyword": f" {k}" if k in ("mit", "isc", "bsd") else k, "rule": f" (?:{r})(?= )", "level": LEVELS.index(p), "sure": s} for a, k, r, p, s in rules])
    return F.from_json(F.lit(rows), "array<struct<label:string,keyword:string,rule:string,level:int,sure:double>>")


def running(values: Column, block: int = 256) -> Column:
    """For each of the values (int) the sum of those before it; in blocks, as a fold copies what it appends to."""

    def scan(xs: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found"))
        return F.aggregate(xs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")), step, lambda acc: acc["found"])

    def of(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x))
        return common.let(scan(totals), lambda starts: F.flatten(F.transform(blocks, lambda xs, i: F.transform(scan(xs), lambda x: x + F.get(starts, i)))))

    count = F.floor((F.size(values) + (block - 1)) / block).cast("int")
    return common.let(F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.slice(values, k * block + 1, F.lit(block))), of)


def detections(spaced: Column) -> Column:
    """All matches of the rules whose keyword the text holds: array of (start, minus length, level, label, sure),
    places in characters. Gaps between matches and the matches' lengths give each place."""

    def places(rule: Column) -> Column:
        def of(hits: Column) -> Column:
            def with_gaps(gaps: Column) -> Column:
                def with_starts(starts: Column) -> Column:
                    return F.transform(hits, lambda hit, i: F.struct(
                        (F.get(starts, i) + F.length(F.get(gaps, i))).alias("start"), (-F.length(hit)).alias("minus"), rule["level"].alias("level"), rule["label"].alias("label"), rule["sure"].alias("sure"),
                    ))

                return common.let(running(F.transform(hits, lambda hit, i: F.length(F.get(gaps, i)) + F.length(hit))), with_starts)

            return F.when(F.size(hits) > 0, common.let(F.split(spaced, rule["rule"], -1), with_gaps))

        return common.let(F.regexp_extract_all(spaced, rule["rule"], F.lit(0)), of)

    met = F.filter(_literal(RULES), lambda r: F.contains(spaced, r["keyword"]))
    return F.flatten(F.array_compact(F.transform(met, places)))


def suppress(found: Column) -> Column:
    """Labels and best confidence of the detections that lie inside none of higher priority and inside no longer
    one of the same. By start, longest first, whatever contains a detection comes before it: it does if its end
    lies no farther than the farthest end so far of a level as high."""

    def step(acc: Column, d: Column) -> Column:
        end = d["start"] - d["minus"]
        keep = end > F.array_max(F.slice(acc["ends"], F.lit(1), d["level"] + 1))
        return F.struct(
            F.transform(acc["ends"], lambda x, i: F.when(i == d["level"], F.greatest(x, end)).otherwise(x)).alias("ends"),
            F.when(keep, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(keep, F.greatest(acc["sure"], d["sure"])).otherwise(acc["sure"]).alias("sure"),
        )

    zero = F.struct(F.array(*[F.lit(-1)] * len(LEVELS)).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("sure"))
    return F.aggregate(F.array_sort(found), zero, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["sure"].alias("sure")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    gate = F.lit(False)
    for term in gate_terms():
        gate = gate | F.contains("spaced", F.lit(term))
    rows = docs.select("doc_id", words_of(text).alias("spaced")).withColumn("n_words", count_words(F.col("spaced")).cast("long"))
    none = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("sure"))
    rows = rows.withColumn("base", base_places(F.col("spaced"), F.col("n_words")))
    rows = rows.withColumn("more", F.when(gate, suppress(detections(F.col("spaced")))).otherwise(none))
    sure = F.when(F.col("base.n_base") > 0, F.greatest(F.col("more.sure"), F.lit(0.75))).otherwise(F.col("more.sure"))
    joined = lambda *x: F.array_join(F.array_sort(F.array_distinct(F.concat(*x))), ",")
    return rows.select(
        "doc_id", "n_words", "base.n_base", "base.first_word", "base.last_word",
        joined(F.col("base.labels")).alias("base_labels"),
        joined(F.col("base.labels"), F.col("more.labels")).alias("labels"),
        sure.alias("score"),
    )
