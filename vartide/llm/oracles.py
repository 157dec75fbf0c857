"""SQL for the operators that SQL can express: plain statements of the contracts over whole tables."""

from __future__ import annotations

from vartide.llm.media import SAMPLE_RATE
from vartide.llm.urls import BLOCKED_PARTS, RULES

#: Python's white space, as str.strip and str.split know it.
_BLANK = "(SELECT string_agg(chr(c), '') FROM (SELECT unnest([9,10,11,12,13,28,29,30,31,32,133,160,5760,8192,8193,8194,8195,8196,8197,8198,8199,8200,8201,8202,8232,8233,8239,8287,12288]) AS c))"

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE
    WHEN len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM words
), named AS (
  SELECT doc_id, len(s) AS n, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class FROM sets
), members AS (
  SELECT doc_id AS class, n, unnest(s) AS shingle FROM named WHERE doc_id = class
), pairs AS (
  SELECT a.class AS a, b.class AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.class < b.class GROUP BY a.class, b.class
), links AS (
  SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT class AS a, class AS b FROM named
  UNION
  SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM named JOIN least ON class = a
"""

# 47 + 30 bytes of header, 8 of framing around each full chunk, 4 and the size's digits around a shorter last one, 5 pos the end
ARCHIVED_PAGES = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), q AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM p
), r AS (
  SELECT *, n >= 1000 AND page_id <> last AS again, HEAD + n + 8 * (n // 8192) + CASE WHEN n % 8192 > 0 THEN 4 + length(to_hex(n % 8192)) ELSE 0 END + 5 AS block FROM q
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN last END AS refers_to, TRUE AS complete, CAST(CASE WHEN again THEN 1 ELSE (block + 32767) // 32768 END AS INTEGER) AS n_segments
FROM r
""".replace("HEAD", str(len("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n") + len("Transfer-Encoding: chunked\r\n\r\n")))

REPEATED_LINES = rf"""
WITH every AS (
  SELECT doc_id, unnest(split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), trimmed AS (
  SELECT doc_id, pos, trim(line, {_BLANK}) AS line FROM every
), lines AS (
  SELECT doc_id, pos, line, row_number() OVER d AS k, lead(line) OVER d AS follows,
         len(regexp_extract_all(line, '[^' || {_BLANK} || ']+')) AS n_words
  FROM trimmed WHERE line <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), windows AS (
  SELECT doc_id, k, 2 AS size, line, follows FROM lines WHERE follows IS NOT NULL
  UNION ALL
  SELECT doc_id, k, 1, line, NULL FROM lines WHERE n_words >= 50
), later AS (
  SELECT doc_id, k, size FROM (SELECT *, row_number() OVER (PARTITION BY size, line, follows ORDER BY doc_id, k) AS nth FROM windows) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, k + unnest(range(size)) AS k FROM later
), marked AS (
  SELECT l.doc_id, l.pos, g.k IS NOT NULL AS gone FROM lines l LEFT JOIN gone g USING (doc_id, k)
), reach AS (
  SELECT doc_id, pos, gone, CASE WHEN lead(gone) OVER d THEN lead(pos) OVER d ELSE pos + 1 END AS until FROM marked WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), dropped AS (
  SELECT doc_id, unnest(range(pos, until)) AS pos FROM reach WHERE gone
), stays AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS rest FROM every ANTI JOIN dropped USING (doc_id, pos) GROUP BY doc_id
), counts AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS n_gone FROM marked GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM documents LEFT JOIN counts USING (doc_id) LEFT JOIN stays USING (doc_id)
"""

REPEATED_BYTES = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), parts AS (
  SELECT doc_id, n, pos, substring(x, 2 * pos + 1, 8398) AS x FROM (SELECT *, unnest(range(0, n, 4000)) AS pos FROM d)
), starts AS (
  SELECT doc_id, pos + i AS pos, md5_number(substring(x, 2 * i + 1, 400)) AS h FROM (SELECT *, unnest(range(0, least(4000, n - pos - 199))) AS i FROM parts)
), twice AS (
  SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before
  FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY h) AS times FROM starts) WHERE times > 1
), runs AS (
  SELECT doc_id, min(pos) AS a, max(pos) + 200 AS b
  FROM (SELECT *, sum(CASE WHEN pos - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM twice) GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a AS stop, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM runs
  UNION ALL
  SELECT doc_id, any_value(n), coalesce(max(b), 0) FROM d LEFT JOIN runs USING (doc_id) GROUP BY doc_id
), rest AS (
  SELECT doc_id, string_agg(substring(x, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start) AS x FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
), counts AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(rest.x)) AS kept_sha256
FROM d JOIN rest USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

# a text and its sample file: 44 bytes of RIFF header (8-bit mono PCM) before the payload; the checksum of the last 64 bytes bit by bit
STORED_SAMPLES = r"""
WITH t AS (
  SELECT DISTINCT coalesce(text, '') AS text FROM documents
), u AS (
  SELECT sha256(text) AS id, hex(encode(text)) AS x, octet_length(encode(text)) AS n FROM t
), p AS (
  SELECT id, n, greatest(64, (n + 63) // 64 * 64) AS size, x || repeat('00', greatest(64, (n + 63) // 64 * 64) - n) AS x FROM u
), parts AS (
  SELECT id, pos, substring(x, 2 * pos + 1, 8000) AS x FROM (SELECT *, unnest(range(0, size, 4000)) AS pos FROM p)
), samples AS (
  SELECT id, pos + i AS pos, CAST('0x' || substring(x, 2 * i + 1, 2) AS INTEGER) AS v FROM (SELECT *, unnest(range(0, length(x) // 2)) AS i FROM parts)
), steps AS (
  SELECT *, lag(v) OVER (PARTITION BY id ORDER BY pos) AS before FROM samples
), figures AS (
  SELECT id, count(*) AS n_samples, sum(v - 128) AS total, sum((v - 128) * (v - 128)) AS energy, count(*) FILTER ((v >= 128) <> (before >= 128)) AS crossings,
         list(v ORDER BY pos) AS vs
  FROM steps GROUP BY id
), levels AS (
  SELECT id, array_to_string(list_transform(range(16), lambda k: count_by[k + 1] * 1000 // n_samples), ',') AS said
  FROM (SELECT id, count(*) AS n_samples, [LEVELS] AS count_by FROM samples GROUP BY id)
), tails AS (
  SELECT id, xor(list_reduce(range(512), lambda c, k: xor(xor(c, CASE WHEN k % 8 = 0 THEN vs[len(vs) - 63 + k // 8]::BIGINT ELSE 0 END) >> 1,
         CASE WHEN xor(c, CASE WHEN k % 8 = 0 THEN vs[len(vs) - 63 + k // 8]::BIGINT ELSE 0 END) % 2 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
  FROM figures
), files AS (
  SELECT id, hex(encode('RIFF')) || LE_ALL || hex(encode('WAVEfmt ')) || '1000000001000100' || 'RATE' || 'RATE' || '01000800' || hex(encode('data')) || LE_SIZE || x AS media FROM p
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(size AS BIGINT) AS payload_bytes, sha256(unhex(x)) AS payload_sha256, CAST(crc AS BIGINT) AS tail_crc32,
       CAST(size + 44 AS BIGINT) AS media_bytes, sha256(unhex(media)) AS media_sha256,
       'n=' || n_samples || ';sum=' || total || ';energy=' || energy || ';crossings=' || crossings || ';levels=' || said AS feature,
       CASE WHEN trim(source) <> '' THEN 1 ELSE 0 END AS position, 'text of document ' || doc_id AS caption,
       CASE WHEN trim(source) <> '' THEN 'text:' || trim(source) || '::|' ELSE '' END || 'media::text of document ' || doc_id || ':' || n || '|' || CASE WHEN trim(lang) <> '' THEN 'text:' || trim(lang) || '::|' ELSE '' END
       || 'media::nothing:' || CASE WHEN EXISTS (SELECT 1 FROM p WHERE n = 0) THEN '0' ELSE '' END || '|text:end::' AS sequence
FROM documents d JOIN p ON p.id = sha256(coalesce(d.text, '')) JOIN figures USING (id) JOIN levels USING (id) JOIN tails USING (id) JOIN files USING (id)
"""
for _name, _value in (("LE_ALL", "size + 36"), ("LE_SIZE", "size")):
    STORED_SAMPLES = STORED_SAMPLES.replace(_name, " || ".join(f"lpad(to_hex((({_value}) >> {k}) & 255), 2, '0')" for k in (0, 8, 16, 24)))
STORED_SAMPLES = STORED_SAMPLES.replace("LEVELS", ", ".join(f"count(*) FILTER (v // 16 = {k})" for k in range(16))).replace("RATE", SAMPLE_RATE.to_bytes(4, "little").hex())



def _crc_table() -> list[int]:
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ 0xEDB88320 * (c & 1) for c in table]
    return table


def _crc32(said: str) -> str:
    """SQL of the checksum of a string's UTF-8 bytes, byte by byte."""
    bytes_ = f"list_transform(range(octet_length(encode({said}))), lambda i: CAST('0x' || substring(hex(encode({said})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[xor(c, b) % 256 + 1])), 4294967295::BIGINT)"


def _moves() -> str:
    """Rows of the repair's transitions: state, initial that it needs, edits' letters, state after, cost, inserted roles; every
    edit with none, one or two insertions behind it."""
    after, kept, roles, rows = (2, 2, 3, 2), ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), {2: "user", 3: "assistant"}, []
    for s in range(4):
        for letter, initial, to, cost in [("D", None, s, 2), ("R", None, after[s], 1), *(("K", i, t, 0) for i, t in kept[s].items())]:
            made, new, state = "NULL" if initial is None else f"'{initial}'", "", to
            for k in range(3):
                rows.append(f"({s}, {made}, '{letter}{'I' * k}', '{roles.get(to, '')}', {state}, {cost + 5 * k}, '{new}')")
                state = after[state]
                new += "|" + roles[state] + ":"
    return ", ".join(rows)


REPAIRED = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), dealt AS (
  SELECT *, CRC % 20 AS kind FROM named
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM dealt WHERE kind <> 0
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos FROM damaged
), faulty AS (
  SELECT *, substring(role, 1, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM faulty) GROUP BY conv_id
), moves AS (
  SELECT * FROM (VALUES MOVES) AS m(before, needs, letters, becomes, after, price, made)
), paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, state, CAST(cost AS BIGINT) AS cost, audit, said
  FROM (SELECT conv_id FROM counts), (VALUES (0, 0, '', ''), (2, 5, 'I', chr(10) || 'user:'), (3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')) AS s(state, cost, audit, said)
  UNION ALL
  SELECT conv_id, pos, state, cost, audit, said FROM (
    SELECT p.conv_id, f.pos, m.after AS state, p.cost + m.price + CASE WHEN f.fault = 'truncated' AND letters NOT LIKE 'D%' THEN 5 ELSE 0 END AS cost, p.audit || m.letters AS audit,
           p.said || CASE WHEN letters LIKE 'D%' THEN '' ELSE chr(10) || CASE WHEN letters LIKE 'K%' THEN f.role ELSE m.becomes END || ':' || f.text END || replace(m.made, '|', chr(10)) AS said
    FROM paths p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1 JOIN moves m ON m.before = p.state AND (m.needs IS NULL OR m.needs = f.initial)
    WHERE letters LIKE 'D%' OR f.fault NOT IN ('blank', 'duplicate')
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
), ended AS (
  SELECT p.conv_id, cost, audit, substring(said, 2) AS said
  FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.pos = c.n WHERE state IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY cost, audit) = 1
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
""".replace("CRC", _crc32("name")).replace("MOVES", _moves())

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_GRAMS = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram"

RESAMPLED = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents
), g AS (
  SELECT r, {_GRAMS} FROM d
), b AS (
  SELECT {_GRAMS} FROM (SELECT {_TERMS} AS w FROM benchmark)
), named AS MATERIALIZED (
  SELECT gram, {_crc32("gram")} % 10000 AS bucket FROM (SELECT gram FROM g UNION SELECT gram FROM b)
), f AS (
  SELECT r, bucket FROM g JOIN named USING (gram)
), s AS (
  SELECT bucket, count(*) AS s FROM f GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM b JOIN named USING (gram) GROUP BY bucket
), totals AS (
  SELECT (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) FROM s) AS all_s, (SELECT CAST(coalesce(sum(t), 0) AS DOUBLE) FROM t) AS all_t
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + CAST(1 AS DOUBLE)) * (all_s + 10000) / ((s + CAST(1 AS DOUBLE)) * (all_t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), totals
), weights AS (
  SELECT r, count(*) AS n, sum(gain) AS weight FROM f JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substring(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)
), ranks AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS place, count(*) OVER () AS n_enough FROM scored WHERE n_words >= 20
)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN place <= 5 * n_enough // 100 THEN place END AS rank, CAST(n_words AS BIGINT) AS n_words
FROM scored LEFT JOIN ranks USING (r)
"""

FILTERED = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS r
  FROM pages
), rules AS (
  SELECT * FROM (VALUES RULES) AS x(action, rule_host, rule_path)
), fits AS (
  SELECT r, action, rule_host || rule_path AS rule FROM parts, rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN regexp_matches(host, '(^|[.-])(PARTS)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (r)
""".replace("RULES", ", ".join(map(str, RULES))).replace("PARTS", "|".join(BLOCKED_PARTS))

ORACLE_SQL = {
    "op2_neardup": NEAR_DUPLICATES, "op4_media": STORED_SAMPLES, "op7_warc": ARCHIVED_PAGES, "op9_lines": REPEATED_LINES, "op10_repeats": REPEATED_BYTES,
    "op11_dialogue": REPAIRED, "op12_resample": RESAMPLED, "op13_urls": FILTERED,
}
