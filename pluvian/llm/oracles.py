"""DuckDB SQL for the queries that SQL can express: 2, 4, 5, 6, 9, 12 and 13.

The others rest on hashes, trained weights or parsing that DuckDB has not; they are tested against plain versions.
"""

from pluvian.llm.quality import RULES
from pluvian.llm.urls import DEPTH, VARIABLE

WS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX = f"""WITH u AS (SELECT doc_id, source, CAST(len({WS}) AS BIGINT) AS size, CAST('0x' || substr(md5('42:=' || doc_id), 1, 15) AS BIGINT) AS h FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM u GROUP BY source),
 w AS (SELECT *, [5.0e0, 2.0e0, 1.0e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
 r AS (SELECT *, 3.0e0 * source_size AS cap, 3.0e0 * source_size / weight AS ratio FROM w),
 v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
   / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
 t AS (SELECT source, source_size, least(coalesce((SELECT arg_min(level, ratio) FROM v WHERE level <= ratio) * weight, cap), cap) AS target FROM v),
 b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
 c AS (SELECT u.*, source_size, target, whole, target - whole * source_size AS budget, sum(size) OVER (PARTITION BY u.source ORDER BY h) AS upto
   FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, size * (whole + CASE WHEN upto <= budget OR (upto - size <= budget AND upto - budget < budget - (upto - size)) THEN 1 ELSE 0 END) AS taken FROM c"""

STEPS = ", ".join(
    f"{{rule: '{r.name}', step: " + ("" if r.high else f"{r.steps} - ")
    + f"CAST(least(greatest(floor((({r.measure.replace(' / ', ' * 1e0 / ')}) - {r.low}e0) / ({r.top}e0 - {r.low}e0) * {r.steps}), 0), {r.steps}) AS INT)}}"
    for r in RULES)
ALPHA, DELTA = 0.02, 0.05
P = ALPHA / len(RULES)

QUALITY = f"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WS} AS ws FROM documents),
 k AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
 rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM k) WHERE n > 1),
 cov AS (SELECT doc_id, sum(least(8, i - before)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8) AS before FROM rep) GROUP BY doc_id),
 ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
 m AS (SELECT doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
 st AS (SELECT *, [{STEPS}] AS steps FROM m),
 good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
 cell AS (SELECT lang, c.rule AS rule, c.step AS step, count(*) AS n FROM (SELECT lang, unnest(steps) AS c FROM st JOIN good USING (doc_id)) GROUP BY ALL),
 test AS (SELECT lang, rule, step, sum(n) OVER (PARTITION BY lang, rule) AS total, coalesce(sum(n) OVER (PARTITION BY lang, rule ORDER BY step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM cell),
 tail AS (SELECT *, CASE WHEN k >= total * {P}e0 THEN 1e0 ELSE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i: exp(lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1) + i * ln({P}e0) + (total - i) * ln(1 - {P}e0)))) END AS p FROM test),
 cut AS (SELECT lang, rule, min(step) AS cutoff FROM tail WHERE p <= {DELTA}e0 / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM cell)) * {len(RULES)}) GROUP BY lang, rule),
 hit AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, lang, unnest(steps) AS c FROM st) x JOIN cut ON x.lang IS NOT DISTINCT FROM cut.lang AND c.rule = cut.rule AND c.step > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND doc_id NOT IN (SELECT doc_id FROM hit) AS kept FROM m"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = (f"translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, "
         "regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path")
NUMBER = r"try_cast(nullif(regexp_extract(url, '/([0-9]{1,18})(?:/|\.html)?(?:[?#]|$)', 1), '') AS BIGINT)"
SUMS = "CAST(sum(n) AS BIGINT) AS n, CAST(sum(labelled) AS BIGINT) AS labelled, CAST(sum(bad) AS BIGINT) AS bad"


def _level(d: int) -> str:
    """One level of the tree: t{d} to t{d + 1}."""
    return f""" s{d} AS (SELECT *, regexp_replace(segs[{d + 1}], '{VARIABLE}', '*\\1') AS seg FROM t{d}),
 c{d} AS (SELECT host, template, seg, {SUMS} FROM s{d} WHERE seg IS NOT NULL GROUP BY ALL),
 n{d} AS (SELECT host, template, count(*) FILTER (NOT starts_with(seg, '*')) AS kinds, sum(n) FILTER (NOT starts_with(seg, '*')) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM c{d} GROUP BY ALL),
 g{d} AS (SELECT host, template, seg, CASE WHEN starts_with(seg, '*') THEN seg WHEN a.kinds > 20 AND a.n < 3.0e0 * a.kinds THEN '*'
   WHEN coalesce(a.labelled = 0 OR abs(c.bad - c.labelled * (a.bad * 1e0 / a.labelled)) <= 1.96e0 * sqrt(c.labelled * (a.bad * 1e0 / a.labelled) * (1 - a.bad * 1e0 / a.labelled)), true) THEN '~' ELSE seg END AS branch
   FROM c{d} c JOIN n{d} a USING (host, template)),
 t{d + 1} AS (SELECT s.host, s.path, s.segs, s.template || coalesce('/' || branch, '') AS template, s.n, s.labelled, s.bad FROM s{d} s LEFT JOIN g{d} USING (host, template, seg))"""


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


URLS = f"""WITH p AS (SELECT page_id, url, CASE WHEN contains(coalesce(url, ''), '://') THEN url ELSE '://' END AS u FROM pages),
 l AS (SELECT page_id, {SPLIT.replace("(url,", "(u,")} FROM p),
 mk AS (SELECT {SPLIT}, CAST(quality = 0 OR toxic = 1 AS BIGINT) AS bad FROM pages JOIN labels ON {NUMBER} = doc_id WHERE (quality = 0 OR toxic = 1) IS NOT NULL),
 a AS (SELECT host, path, 1 AS n, 0 AS labelled, 0 AS bad FROM l UNION ALL SELECT host, path, 0, 1, bad FROM mk),
 f AS (SELECT host, path, {SUMS} FROM a GROUP BY host, path),
 t0 AS (SELECT host, path, CASE WHEN len(x) <= {DEPTH} THEN x ELSE list_append(x[1:{DEPTH - 1}], array_to_string(x[{DEPTH}:], '/')) END AS segs, '' AS template, n, labelled, bad
   FROM (SELECT *, list_filter(string_split(path, '/'), lambda y: y <> '') AS x FROM f)),
{", ".join(_level(d) for d in range(DEPTH))},
 pt AS (SELECT host, template, sum(labelled) AS k, sum(bad) AS b FROM t{DEPTH} GROUP BY ALL),
 ph AS (SELECT host, sum(k) AS hk, sum(b) AS hb FROM pt GROUP BY host),
 al AS (SELECT coalesce(sum(bad) * 1e0 / nullif(sum(labelled), 0), 0e0) AS r FROM f),
 q AS (SELECT host, template, (b + 10e0 * ((hb + 10e0 * r) / (hk + 10e0))) / (k + 10e0) AS rate FROM pt JOIN ph USING (host), al)
SELECT page_id, host, path, rule, coalesce(CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END, CASE WHEN rate > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, round(rate, 6) AS bad_rate
FROM (SELECT l.*, template, rate, CASE WHEN {_fits('example.com', '/de/')} THEN 'example.com/de/' WHEN {_fits('example.net', '/en/')} THEN 'example.net/en/'
  WHEN {_fits('org', '/fr/')} THEN 'org/fr/' WHEN {_fits('net', '/')} THEN 'net/' END AS rule FROM l JOIN t{DEPTH} USING (host, path) JOIN q USING (host, template))"""

#: Every control string, escaped or not, gets one backslash more.
CONTROLS = r"'\[/?\\*(?:INST|ROLE)\]|</?\\*s>'"

CHATS = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(i)),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, length(text) + len(regexp_extract_all(text, {CONTROLS}))
   + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 14 + length(replace(replace(role, '\', '\\'), chr(10), '\n')) + len(regexp_extract_all(role, {CONTROLS})) END AS n FROM c),
 s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto, max(k) OVER (PARTITION BY conv_id) AS last FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
 CAST(length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(upto) FILTER (role = 'assistant' OR k = last) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id"""

REPEATS = f"""WITH w AS (SELECT doc_id, {WS} AS ws FROM documents),
 k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
 f AS (SELECT g, min(doc_id) AS first FROM k GROUP BY g),
 c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM k JOIN f USING (g) WHERE doc_id > first),
 x AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
 y AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
 z AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM y ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN x USING (doc_id) LEFT JOIN z USING (doc_id)"""

TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = f"""WITH d AS (SELECT doc_id, {TERMS} AS ts FROM documents),
 s AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
 it AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
 tf AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
 df AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs),
 sc AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM it JOIN tf USING (term) JOIN df USING (term), s GROUP BY item_id, doc_id),
 r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""

PHRASES = rf"""WITH p AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents)),
 w AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
 f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang, ws, i, unnest([1, 2, 3]) AS k FROM w) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
 c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 10),
 cut AS (SELECT lang, phrase, k, a, j, array_to_string(ws[1:j], ' ') AS front, array_to_string(ws[j + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
 sc AS (SELECT cut.*, x.n AS l, y.n AS r, CAST((CAST(a AS HUGEINT) * a * 1000000) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
   FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = front JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
 low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM sc) WHERE place = 1),
 cov AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase FROM c WHERE k = 3) GROUP BY lang, phrase),
 t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
 o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, t.n AS n, score
   FROM low JOIN t USING (lang) LEFT JOIN cov USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000"""

ORACLES: dict[str, str] = {
    "op2_mix_sources": MIX, "op4_quality_rules": QUALITY, "op5_url_filter": URLS, "op6_chat_format": CHATS,
    "op9_substring_dedup": REPEATS, "op12_ranked_search": SEARCH, "op13_collocations": PHRASES,
}
