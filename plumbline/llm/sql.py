"""SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import ACROSS, COPYRIGHT_LINE, KNOWN, SPELLINGS
from .quality import CLASSES, Limits
from .secret_scan import BASE, MORE
from .urls import TWO_LABEL_SUFFIXES

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x20\x09-\x0D]+'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


MIXING_SQL = rf"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, {_WORD})), 0)::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, '~') || ':' || coalesce(md5(text), '~')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
w AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS kind FROM s),
v AS (SELECT *, ([5.0, 2.0, 1.0])[kind + 1]::DOUBLE AS weight, 2 * ss AS cap FROM w),
o AS (
  SELECT *, cap / weight AS ratio,
         sum(cap) OVER r - cap AS capped,
         sum(weight) OVER () - (sum(weight) OVER r - weight) AS rest,
         1.5 * sum(ss) OVER () AS total
  FROM v WINDOW r AS (ORDER BY cap / weight, source ROWS UNBOUNDED PRECEDING)),
l AS (
  SELECT min_by((total - capped) / rest, ratio) FILTER ((total - capped) / rest <= ratio) AS level FROM o),
t AS (
  SELECT source, ss, kind, least(cap::DOUBLE, coalesce(level, 'infinity'::DOUBLE) * weight) AS target
  FROM v, l),
p AS (
  SELECT d.*, ss, kind, target,
         sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS UNBOUNDED PRECEDING) - size AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CASE WHEN size = 0 THEN 1 ELSE
         greatest(0, least(2, floor((target - place - size / 2) / ss) + 1)) END AS copies,
         CASE WHEN target > 0 THEN least(place / target, 1.0) ELSE 0.0 END AS q
  FROM p)
SELECT doc_id, size, ss AS source_size, target, (size * copies)::BIGINT AS taken,
       CASE WHEN copies = 0 THEN NULL
            WHEN kind = 0 THEN
              CASE WHEN q * 5 <= 2.75 THEN least(2 * (q * 5) / (6 + sqrt(36 - 4 * (q * 5))), 0.5)
                   ELSE least(0.5 + 2 * (q * 5 - 2.75) / (5 + sqrt(greatest(25 - 4 * (q * 5 - 2.75), 0))), 1) END
            WHEN kind = 1 THEN q
            ELSE CASE WHEN q <= 0.375 THEN least(2 * q / (0.5 + sqrt(0.25 + 2 * q)), 0.5)
                      ELSE least(0.5 + 2 * (q - 0.375) / (1 + sqrt(1 + 2 * (q - 0.375))), 1) END
       END::DOUBLE AS first_position
FROM c
"""

_SECRET_ROWS = ", ".join(
    f"({_q(r.kind)}, {i}, {_q(_p)}, {r.least}, {str(i < len(BASE)).lower()})"
    for i, r in enumerate([*BASE, *MORE])
    for _p in [r.pattern.replace("[A-Za-z0-9+/_.=-]+", "([A-Za-z0-9+/_.=-]+)") if r.value else f"({r.pattern})"])

SECRETS_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
k(kind, ord, pat, least, base) AS (VALUES {_SECRET_ROWS}),
x AS (
  SELECT rid, kind, ord, least, base, regexp_extract_all(text, pat) AS m,
         regexp_extract_all(text, pat, 1) AS g, string_split_regex(text, pat) AS s
  FROM t, k WHERE regexp_matches(text, pat)),
y AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM x),
z AS (
  SELECT rid, kind, ord, base, length(m[i]) AS size,
         (list_sum(list_transform(s[1:i], lambda a: length(a)))
          + coalesce(list_sum(list_transform(m[1:i-1], lambda a: length(a))), 0))::BIGINT AS start
  FROM y WHERE length(g[i]) >= least),
l AS (
  SELECT rid, string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, ord) AS spans,
         string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, ord)
           FILTER (base) AS base_spans,
         count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex
  FROM z GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM t LEFT JOIN l USING (rid)
"""


def _strength(table: str, mean: str) -> str:
    return f"""(SELECT 1 / r - 1 FROM (SELECT least(greatest(coalesce(
      CASE WHEN sum(n) - count(*) <> 0 AND any_value(rate) * (1 - any_value(rate)) <> 0 THEN
      (sum(n * pow(bad / n - {mean}, 2)) / (any_value(rate) * (1 - any_value(rate))) - count(*))
      / (sum(n) - count(*)) END, 0.01), 0.01), 0.99) AS r FROM {table}, g WHERE n > 0))"""


URLS_SQL = rf"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {_AZ}), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
o AS (
  SELECT doc_id AS page_id, max(quality = 0 OR toxic = 1) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
b AS (
  SELECT host, count(bad) AS n, count(*) FILTER (bad) AS bad,
         regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare
  FROM p LEFT JOIN o USING (page_id) GROUP BY host),
a AS (SELECT *, string_split(bare, '.') AS parts FROM b),
e AS (
  SELECT *, array_to_string(parts[-2:], '.') AS two, array_to_string(parts[-3:], '.') AS three FROM a),
h AS (
  SELECT host, n, bad,
         CASE WHEN two IN ({", ".join(map(_q, TWO_LABEL_SUFFIXES))}) THEN two ELSE parts[-1] END AS suffix,
         CASE WHEN two IN ({", ".join(map(_q, TWO_LABEL_SUFFIXES))}) THEN three ELSE two END AS domain
  FROM e),
g AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 5.0)::DOUBLE AS rate FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT rate FROM g) AS top FROM h GROUP BY suffix),
s AS (SELECT suffix, (bad + k * top) / (n + k) AS suffix_mean
      FROM s0, (SELECT {_strength("s0", "top")} AS k)),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(suffix_mean) AS suffix_mean
       FROM h JOIN s USING (suffix) GROUP BY domain, suffix),
d AS (SELECT domain, suffix, (bad + k * suffix_mean) / (n + k) AS domain_mean
      FROM d0, (SELECT {_strength("d0", "suffix_mean")} AS k)),
h0 AS (SELECT host, n, bad, domain_mean FROM h JOIN d USING (domain, suffix)),
h1 AS (SELECT host, bad + k * domain_mean AS a, n - bad + k * (1 - domain_mean) AS b
       FROM h0, (SELECT {_strength("h0", "domain_mean")} AS k)),
r AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM h1),
x AS (SELECT page_id, host, path, low,
        CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1')
               THEN 'example.org/en/1'
             WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/')
               THEN 'example.org/es/'
             WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
             WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
             WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
      FROM p JOIN r USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN low > 0.25 THEN 'block' ELSE 'allow' END AS verdict
FROM x
"""

_L = Limits()
_LIST = "list_transform(range(1, len(p) + 1), lambda i: {})"
_COUNTED = ", ".join(f"len(regexp_extract_all(text, {_q(c)}))" for c in CLASSES.values())


def _distance(p: str, q: str) -> str:
    a, b = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
    part = "CASE WHEN {x} > 0 THEN {x} * log2({x} / (({a} + {b}) / 2)) ELSE 0.0 END"
    both = f"({part.format(x=a, a=a, b=b)} + {part.format(x=b, a=a, b=b)}) / 2"
    return (f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0.0, list_sum("
            f"list_transform(range(1, len({p}) + 1), lambda i: {both})))) END")


QUALITY_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text
  FROM documents),
w AS (SELECT *, regexp_extract_all(text, {_WORD}) AS w, len(regexp_extract_all(text, {_WORD})) AS n FROM t),
e AS (SELECT rid, lang, unnest(w) AS word FROM w),
c AS (SELECT lang, word, count(*) AS n FROM e GROUP BY lang, word),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c),
top AS (SELECT lang, word, rank FROM r WHERE rank <= {_L.common_words}),
hit AS (SELECT rid, rank, count(*) AS n FROM e JOIN top USING (lang, word) GROUP BY rid, rank),
hist AS (SELECT rid, map_from_entries(list((rank, n))) AS h, sum(n) AS common FROM hit GROUP BY rid),
win AS (SELECT rid, unnest(range(1, n - 3)) AS i, w FROM w WHERE n > 5),
rep AS (
  SELECT rid, i FROM (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(w[i:i+4], ' ')) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT x) AS n_repeat_words
        FROM (SELECT rid, unnest(range(i, i + 5)) AS x FROM rep) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)),
                 lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
f AS (
  SELECT w.rid, doc_id, lang, n AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(text) AS chars, strlen(text) AS size, [{_COUNTED}] AS counted,
         list_transform(range(1, {_L.common_words + 1}), lambda i: coalesce(h[i], 0))
           || [n - coalesce(common, 0)::BIGINT] AS common
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN hist USING (rid) JOIN lines USING (rid)),
g AS (
  SELECT *, counted || [chars - word_chars, word_chars - list_sum(counted)::BIGINT, size - chars] AS classes
  FROM f),
ref1 AS (SELECT lang, list(s ORDER BY i) AS ref_classes FROM (
  SELECT lang, i, sum(classes[i])::DOUBLE AS s FROM (
    SELECT lang, classes, unnest(range(1, len(classes) + 1)) AS i FROM g) GROUP BY lang, i) GROUP BY lang),
ref2 AS (SELECT lang, list(s ORDER BY i) AS ref_common FROM (
  SELECT lang, i, sum(common[i])::DOUBLE AS s FROM (
    SELECT lang, common, unnest(range(1, len(common) + 1)) AS i FROM g) GROUP BY lang, i) GROUP BY lang),
j AS (
  SELECT g.*, {_distance("classes", "ref_classes")} AS cd, {_distance("common", "ref_common")} AS wd,
         n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.max_repeat_pct} * n_words AS base_failed
  FROM g JOIN ref1 USING (lang) JOIN ref2 USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words >= {_L.guard_words}
         AND (coalesce(cd, 0) > {_L.max_class_distance} OR coalesce(wd, 0) > {_L.max_word_distance})) AS kept
FROM j
"""


def _canonical(line: str) -> str:
    low = f"translate({line}, {_AZ})"
    spelt = low
    for other, one in SPELLINGS:
        spelt = f"replace({spelt}, {_q(other)}, {_q(one)})"
    any_of = "|".join(o for o, _ in SPELLINGS)
    chosen = f"CASE WHEN regexp_matches({low}, {_q(any_of)}) THEN {spelt} ELSE {low} END"
    plain = rf"trim(regexp_replace({chosen}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return f"CASE WHEN regexp_matches({low}, {_q(COPYRIGHT_LINE)}) THEN '' ELSE {plain} END"


def _lines(text: str) -> str:
    return (f"list_filter(list_transform(string_split({text}, chr(10)), "
            f"lambda x: {_canonical('x')}), lambda x: x <> '')")


def _whole(lines: str) -> str:
    out = f"array_to_string({lines}, ' ')"
    for other, one in ACROSS:
        out = f"replace({out}, {_q(other)}, {_q(one)})"
    return out


LICENSES_SQL = rf"""
WITH k(i, licence, text) AS (VALUES {", ".join(f"({i}, {_q(n)}, {_q(t)})" for i, (n, t) in enumerate(KNOWN))}),
kd AS (
  SELECT digest, min_by(licence, i) AS licence
  FROM (SELECT i, licence, md5({_whole(_lines("text"))}) AS digest FROM k) GROUP BY digest),
t AS (SELECT row_number() OVER () AS rid, doc_id, {_lines("coalesce(text, '')")} AS lines FROM documents),
w AS (SELECT rid, doc_id, lines, md5({_whole("lines")}) AS digest FROM t),
h AS (
  SELECT rid, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM (SELECT rid, md5(unnest(lines)) AS digest FROM w) JOIN kd USING (digest) GROUP BY rid)
SELECT doc_id, digest, licence, notices FROM w LEFT JOIN kd USING (digest) LEFT JOIN h USING (rid)
"""

NEGATIVES_SQL = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
           CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
       s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

#: A sequence of turns is spelt out as a list; crc32 is computed bit by bit over the digits.
TRIE_SQL = """
WITH own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id
                              ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS at
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
        lambda crc, byte: list_reduce(
            list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, _: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM own)),
heads AS (
    SELECT c.conv_id, o.at AS place, o.role, o.text
    FROM convs c JOIN own o ON o.conv_id = c.base AND o.at <= c.h),
shared AS (SELECT conv_id, max(place) AS n FROM heads GROUP BY conv_id),
turns AS (
    SELECT * FROM heads
    UNION ALL
    SELECT c.conv_id, o.at - c.h + coalesce(s.n, 0), o.role, o.text
    FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.at > c.h LEFT JOIN shared s ON s.conv_id = c.conv_id),
whole AS (
    SELECT c.conv_id, coalesce(list([t.role, t.text] ORDER BY t.place) FILTER (t.place IS NOT NULL), []) AS seq
    FROM convs c LEFT JOIN turns t ON t.conv_id = c.conv_id GROUP BY c.conv_id),
steps AS (
    SELECT conv_id, d AS depth, seq[1:d] AS seq, len(seq) = d AS ends
    FROM whole, LATERAL (SELECT unnest(range(len(seq) + 1)) AS d)),
nodes AS (
    SELECT depth, seq, min(conv_id) AS conv_id, count(*) AS n_convs,
           (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(seq[depth][2]) END AS saved,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM steps GROUP BY depth, seq),
families AS (
    SELECT n.*, p.conv_id AS parent_conv_id,
           (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.seq[1:n.depth] = n.seq) AS n_children
    FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.seq = n.seq[1:n.depth - 1]),
below AS (
    SELECT b.conv_id, b.depth, a.seq, a.depth AS top, b.n_children, b.saved
    FROM families a JOIN families b ON b.depth >= a.depth AND b.seq[1:a.depth] = a.seq)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children,
       CAST(count(*) FILTER (b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens,
       f.ends_sha256
FROM families f JOIN below b ON b.top = f.depth AND b.seq = f.seq
GROUP BY f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, f.ends_sha256
"""
