"""DuckDB SQL of the operators that SQL can express."""

from tabloom.llm import mixing, phrases, quality, resampling

_WS = r"[\x20\x09-\x0D]+"


def _bucket(v: str) -> str:
    shift = f"greatest(length(bin({v})) - 6, 0)"
    return f"({shift} * 32 + ({v} >> {shift}))"


def _edge(b: str) -> str:
    shift = f"greatest({b} // 32 - 1, 0)"
    return f"(({b} - 32 * {shift}) << {shift})"


_RULES = " UNION ALL ".join(
    f"SELECT row_id, doc_id, lang, source, n_words, n_repeat_words, '{k}' AS rule, {r[0]} * 1000 // greatest({r[1]}, 1) AS v, {r[2]} AS spread FROM m"
    for k, r in quality.RULES.items()
)
_FENCE = "{e3} + %d * greatest({e3} - {e1}, spread)" % quality.REACH

QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{_WS}'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS ls FROM d),
win AS (SELECT row_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM w, range(1, greatest(len(ws) - 6, 1)) r(i)),
rep AS (SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, s) AS n FROM win) WHERE n > 1),
gap AS (SELECT row_id, least(8, coalesce(lead(i) OVER (PARTITION BY row_id ORDER BY i) - i, 8)) AS g FROM rep),
cov AS (SELECT row_id, sum(g)::BIGINT AS n FROM gap GROUP BY row_id),
m AS (SELECT w.row_id, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_WS}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
  FROM w LEFT JOIN cov USING (row_id)),
v AS ({_RULES}),
b AS (SELECT *, {_bucket('v')} AS bucket FROM v WHERE NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)),
q AS (SELECT *, rank() OVER p AS lo, count(*) OVER (PARTITION BY g, lang, source, rule) AS n,
    count(*) OVER (PARTITION BY g, lang, source, rule ORDER BY bucket) AS upto
  FROM (SELECT 'f' AS g, lang, source, rule, bucket, spread FROM b UNION ALL SELECT 'm', lang, NULL, rule, bucket, spread FROM b
        UNION ALL SELECT 't', NULL, NULL, rule, bucket, spread FROM b)
  WINDOW p AS (PARTITION BY g, lang, source, rule ORDER BY bucket)),
f AS (SELECT g, lang, source, rule, max(n) AS n, max(spread) AS spread, min(bucket) FILTER (upto * 4 >= n) AS b1,
    min(bucket) FILTER (upto * 4 >= 3 * n) AS b3 FROM q GROUP BY ALL),
e AS (SELECT g, lang, source, rule, n, {_FENCE.format(e1=_edge('b1'), e3=_edge('b3'))} AS fence FROM f),
over AS (SELECT v.row_id, bool_or(v.v > CASE WHEN f.n >= {quality.LEAST_DOCUMENTS} THEN f.fence
    WHEN m2.n >= {quality.LEAST_DOCUMENTS} THEN m2.fence ELSE t2.fence END) AS bad
  FROM v JOIN e f ON f.g = 'f' AND f.rule = v.rule AND f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source
  JOIN e m2 ON m2.g = 'm' AND m2.rule = v.rule AND m2.lang IS NOT DISTINCT FROM v.lang
  JOIN e t2 ON t2.g = 't' AND t2.rule = v.rule GROUP BY v.row_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT coalesce(bad, false) AS kept
FROM m LEFT JOIN over USING (row_id)
"""


def _case(level: str, named: dict[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}::DOUBLE" for k, v in named.items()) + f" ELSE {mixing.DEFAULT}::DOUBLE END"


def _level(name: str, keys: list[str], weight: str, parent: str | None) -> str:
    above = keys[:-1]
    on = " AND ".join(f"n.{k} IS NOT DISTINCT FROM p.{k}" for k in above) or "true"
    part = "PARTITION BY " + ", ".join(above) if above else ""
    cols = ", ".join(keys)
    return f"""
{name}_n AS (SELECT {cols}, sum(cap) AS capacity, {weight} AS weight FROM leaf GROUP BY {cols}),
{name}_b AS (SELECT n.*, p.budget FROM {name}_n n JOIN {parent or 'root'} p ON {on}),
{name}_o AS (SELECT *, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM {name}_b
  WINDOW o AS ({part} ORDER BY capacity / weight, {keys[-1]} NULLS FIRST)),
{name}_f AS (SELECT *, capacity * open <= weight * (budget - used) AS is_full FROM {name}_o),
{name} AS (SELECT {cols}, CASE WHEN is_full THEN capacity ELSE coalesce(weight *
    (budget - min(used) FILTER (NOT is_full) OVER ({part})) / max(open) FILTER (NOT is_full) OVER ({part}), 0) END AS budget FROM {name}_f)"""


MIXING_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER), 0) % 3 AS k,
  len(list_filter(string_split_regex(coalesce(text, ''), '{_WS}'), lambda x: x <> ''))::BIGINT AS n_tokens,
  concat_ws(':', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, ''))) AS ident FROM documents),
i AS (SELECT *, CASE k WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END AS domain FROM d),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {mixing.EPOCHS})::DOUBLE AS cap FROM i GROUP BY ALL),
root AS (SELECT least(sum(tokens) * {mixing.SHARE}::DOUBLE, sum(cap)) AS budget FROM leaf),
{_level('l1', ['domain'], _case('domain', mixing.DOMAINS), None)},
{_level('l2', ['domain', 'lang'], _case('lang', mixing.LANGUAGES), 'l1')},
{_level('l3', ['domain', 'lang', 'source'], f'{mixing.DEFAULT}::DOUBLE', 'l2')},
p AS (SELECT l.domain, l.lang, l.source, tokens, floor(budget + 1e-6)::BIGINT AS budget,
  CASE WHEN tokens > 0 THEN floor(budget + 1e-6)::BIGINT // tokens ELSE 0 END AS passes
  FROM leaf l JOIN l3 b ON l.domain = b.domain AND l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source),
r AS (SELECT i.*, p.budget, p.passes, p.budget - p.passes * p.tokens AS rest, md5(concat_ws(':', '{mixing.SEED}', p.passes::VARCHAR, ident)) AS o
  FROM i JOIN p ON i.domain = p.domain AND i.lang IS NOT DISTINCT FROM p.lang AND i.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, domain, lang, source, n_tokens, budget AS leaf_budget,
  (passes + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o) <= rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM r
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RESAMPLING_SQL = rf"""
WITH RECURSIVE crc(i, step, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
  SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE step < 8),
t256 AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE step = 8),
w AS (SELECT 'd' AS side, doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL SELECT 'b', NULL, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
v AS (SELECT word, hex(encode(word)) AS hx FROM (SELECT DISTINCT word FROM w)),
sums(word, hx, pos, c) AS (SELECT word, hx, 1, 4294967295::BIGINT FROM v UNION ALL
  SELECT word, hx, pos + 2, xor(c >> 8, (SELECT t FROM t256)[xor(c & 255, ('0x' || substr(hx, pos, 2))::BIGINT) + 1]) FROM sums WHERE pos < length(hx)),
k AS (SELECT word, xor(c, 4294967295) % {resampling.BUCKETS} AS bucket FROM sums WHERE pos > length(hx)),
f AS (SELECT side, doc_id, bucket FROM w JOIN k USING (word)),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + {resampling.BUCKETS})::DOUBLE)
  / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + {resampling.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM n),
x AS (SELECT doc_id, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
r AS (SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT
  + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM r WHERE n_features >= {resampling.LEAST_WORDS})
SELECT r.doc_id, n_features, weight, score, CASE WHEN place <= {resampling.PERCENT} * able // 100 THEN place END AS rank
FROM r LEFT JOIN o ON o.doc_id = r.doc_id
"""


def _grams(n: int) -> str:
    return f"SELECT lang, {" || ' ' || ".join(f'w{k}' for k in range(1, n + 1))} AS phrase FROM g WHERE w{n} IS NOT NULL"


PHRASES_SQL = rf"""
WITH pieces AS (SELECT row_number() OVER () AS piece_id, lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM
  (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT piece_id, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM pieces),
g AS (SELECT lang, w1, {", ".join(f"lead(w1, {k - 1}) OVER o AS w{k}" for k in range(2, phrases.LONGEST + 1))} FROM w WINDOW o AS (PARTITION BY piece_id ORDER BY i)),
f AS (SELECT lang, phrase, lang || chr(0) || phrase AS key, count(*)::BIGINT AS f FROM ({" UNION ALL ".join(_grams(n) for n in range(1, phrases.LONGEST + 1))}) GROUP BY ALL),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE f >= {phrases.LEAST} AND contains(phrase, ' ')),
cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM c, range(1, {phrases.LONGEST}) r(k) WHERE k < len(ws)),
s AS (SELECT cuts.lang, cuts.phrase, a, k, h.f AS l, t.f AS r, (({phrases.SCALE}::HUGEINT * a) // (h.f + t.f))::BIGINT AS score FROM cuts
  JOIN f h ON h.key = cuts.lang || chr(0) || head JOIN f t ON t.key = cuts.lang || chr(0) || tail),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(a) AS over FROM c, range(1, {phrases.LONGEST}) x(i), range(2, {phrases.LONGEST + 1}) y(j)
  WHERE j > i AND j <= len(ws) AND j - i + 1 < len(ws) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ o ON o.lang = best.lang AND o.phrase = best.phrase WHERE 100 * coalesce(over, 0) < {phrases.COVERED} * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE NOT contains(phrase, ' ') GROUP BY lang) n ON n.lang = kept.lang
QUALIFY rank <= {phrases.TOP}
"""
