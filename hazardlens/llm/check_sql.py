"""SQL of the queries that SQL can express."""

from __future__ import annotations

from hazardlens.llm import licenses, mixing, preferences, secret_scan

WORD = r"[^\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def chat_formatting() -> str:
    start, end = preferences.TURN_START, preferences.TURN_END
    turns = """
SELECT DISTINCT conv_id, turn, role, text FROM conversations"""
    rejected = f"""
SELECT DISTINCT c.conv_id, c.turn, c.role,
  CASE WHEN c.role IS DISTINCT FROM 'assistant' OR c.turn IS DISTINCT FROM r.last_turn THEN c.text
       WHEN r.first_turn < r.last_turn THEN r.first_text
       ELSE substr(c.text, 1, cast(floor(length(c.text) / 2) AS int)) END AS text
FROM conversations c LEFT JOIN (
  SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, arg_min(text, (turn, text)) AS first_text
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id) r ON c.conv_id = r.conv_id"""
    return f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM ({turns})),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM ({rejected})),
z AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.k, r.k) AS k, c.k IS NOT NULL AS in_c, r.k IS NOT NULL AS in_r,
    c.role AS c_role, r.role AS r_role,
    replace(coalesce(c.text, ''), '<|', '< |') AS c_text, replace(coalesce(r.text, ''), '<|', '< |') AS r_text,
    c.k IS NOT NULL AND r.k IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.k = r.k),
n AS (SELECT conv_id, coalesce(min(k) FILTER (NOT same) - 1, max(k)) AS n FROM z GROUP BY conv_id),
d AS (
  SELECT z.*, n.n,
    '{start}' || replace(coalesce(c_role, ''), '<|', '< |') || chr(10) || c_text || '{end}' || chr(10) AS c_turn,
    '{start}' || replace(coalesce(r_role, ''), '<|', '< |') || chr(10) || r_text || '{end}' || chr(10) AS r_turn
  FROM z JOIN n USING (conv_id)),
s AS (
  SELECT *,
    sum(CASE WHEN k > n AND in_c THEN length(c_turn) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS c_end,
    sum(CASE WHEN k > n AND in_r THEN length(r_turn) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS r_end
  FROM d)
SELECT conv_id, cast(any_value(n) AS int) AS n_prompt_turns,
  cast(count(*) FILTER (k > n AND in_c) AS int) AS n_chosen_turns,
  cast(count(*) FILTER (k > n AND in_r) AS int) AS n_rejected_turns,
  coalesce(string_agg(c_turn, '' ORDER BY k) FILTER (k <= n), '') AS prompt,
  coalesce(string_agg(c_turn, '' ORDER BY k) FILTER (k > n AND in_c), '') AS chosen,
  coalesce(string_agg(r_turn, '' ORDER BY k) FILTER (k > n AND in_r), '') AS rejected,
  coalesce(string_agg(cast(c_end - length(c_text) - {len(end) + 1} AS varchar) || ':' || cast(c_end - 1 AS varchar), ','
    ORDER BY k) FILTER (k > n AND in_c AND c_role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(cast(r_end - length(r_text) - {len(end) + 1} AS varchar) || ':' || cast(r_end - 1 AS varchar), ','
    ORDER BY k) FILTER (k > n AND in_r AND r_role = 'assistant'), '') AS rejected_spans
FROM s GROUP BY conv_id"""


def mix() -> str:
    seed = mixing.SEED
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
    cast('0x' || substr(md5('{seed}' || chr(10) || coalesce(cast(doc_id AS varchar), '') || chr(10)
      || md5(coalesce(text, ''))), 1, 12) AS bigint) / 281474976710656.0::double AS draw
  FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
t AS (SELECT *, 3 * sum(source_size) OVER () AS twice_total FROM w),
f AS (
  SELECT *, coalesce(sum(source_size) OVER earlier, 0) AS full_size, sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS open_weight
  FROM t WINDOW earlier AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT *, (twice_total - 4 * full_size)::double / (2 * open_weight)::double AS level,
    weight * (twice_total - 4 * full_size) >= source_size * 4 * open_weight AS stops
  FROM f),
o AS (SELECT (SELECT level FROM l WHERE NOT stops ORDER BY source_size / weight, source NULLS LAST LIMIT 1) AS open_level),
g AS (
  SELECT source, source_size, CASE WHEN open_level IS NULL OR stops THEN 2.0 * source_size
    ELSE weight * (twice_total - 4 * full_size_open)::double / (2 * open_weight_open)::double END AS target
  FROM l, o, (SELECT arg_min(full_size, k) AS full_size_open, arg_min(open_weight, k) AS open_weight_open FROM (
    SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM l WHERE NOT stops)))
SELECT doc_id, size, source_size, target,
  cast(CASE WHEN source_size = 0 THEN 0 ELSE size * (floor(target / source_size)
    + CASE WHEN draw < target / source_size - floor(target / source_size) THEN 1 ELSE 0 END) END AS bigint) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source"""


def warc() -> str:
    letters = " || ".join(
        "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + "
        + " + ".join(f"{16 >> k} * (substr(bits, {5 * i + k + 1}, 1) = '1')::int" for k in range(5)) + ", 1)" for i in range(32))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, strlen(html) AS payload_bytes, unhex(sha1(html))::bit::varchar AS bits,
  max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, payload_bytes,
  {letters} AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM h"""


def _canonical(column: str) -> str:
    out = f"replace(lower({column}), 'https://', 'http://')"
    out = f"regexp_replace({out}, {_text('(?m)' + licenses.COPYRIGHT_LINE)}, '', 'g')"
    out = f"trim(regexp_replace({out}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"
    out = f"' ' || replace({out}, ' ', '  ') || ' '"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def license_scan() -> str:
    values = ", ".join(f"({_text(name)}, {_text(text)})" for name, text in licenses.KNOWN)
    return f"""
WITH k AS (SELECT min(name) AS license_id, canonical FROM (
  SELECT name, {_canonical('body')} AS canonical FROM (VALUES {values}) v(name, body)) GROUP BY canonical),
l AS (SELECT row, {_canonical('line')} AS canonical FROM (
  SELECT rowid AS row, unnest(string_split(text, chr(10))) AS line FROM (SELECT row_number() OVER () AS rowid, * FROM documents))),
f AS (SELECT row, count(*) AS n, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS ids
  FROM l JOIN k USING (canonical) GROUP BY row),
d AS (SELECT row_number() OVER () AS row, doc_id, {_canonical('text')} AS canonical FROM documents)
SELECT doc_id, sha256(d.canonical) AS digest, license_id, coalesce(n, 0) AS n_license_lines, coalesce(ids, '') AS line_license_ids
FROM d LEFT JOIN k ON d.canonical = k.canonical LEFT JOIN f ON d.row = f.row"""


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def contamination() -> str:
    words = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words}, []) AS w FROM documents),
i AS (SELECT item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS words
  FROM i, LATERAL (SELECT unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k) WHERE len(w) > 0),
z AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT r, size, k, array_to_string(w[k:k + size - 1], ' ') AS words
  FROM d, z, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS k) WHERE len(w) >= size),
h AS (SELECT r, k, dw.size, item_id FROM dw JOIN iw ON dw.size = iw.size AND dw.words = iw.words),
p AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS pos FROM h) GROUP BY r),
m AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT cast(item_id AS varchar), ',' ORDER BY cast(item_id AS varchar)) AS items
  FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN m USING (r)"""


def jaccard() -> str:
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[k:k + 2], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k)
  WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT x, y FROM p JOIN n nx ON x = nx.r JOIN n ny ON y = ny.r WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT r, r AS m FROM d UNION SELECT reach.r, l.y FROM reach JOIN l ON reach.m = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach USING (r) JOIN d o ON o.r = reach.m GROUP BY d.r, d.doc_id"""


def secrets() -> str:
    """Letters of the names are classes of both cases: a case flag would fold beyond ASCII here."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    assign = f"""({names})["\']?\\x20*[:=]\\x20*["\']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
    kinds = [("assign", assign, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
             (secret_scan.OPAQUE[0], secret_scan.OPAQUE[1], 0, 24)]
    found = " UNION ALL ".join(f"""
  SELECT r, source, repository, {k} AS o, '{kind}' AS kind, end_at - length(m) AS start, end_at, v FROM (
    SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) AS end_at FROM (
      SELECT r, source, repository, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(regexp_extract_all(text, '{pattern}', {group})) AS v,
        unnest(regexp_split_to_array(text, '{pattern}')) AS gap, unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i FROM d) WHERE m IS NOT NULL)
  WHERE length(v) >= {least}""" for k, (kind, pattern, group, least) in enumerate(kinds))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS source,
  coalesce(source, '') || '/' || coalesce(lang, '') AS repository, coalesce(text, '') AS text FROM documents),
f AS MATERIALIZED ({found}),
b AS (SELECT * FROM f WHERE o < 3),
a AS (SELECT * FROM b UNION ALL SELECT * FROM f WHERE o = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]')
  AND regexp_matches(v, '[A-Z]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = f.r AND b.start < f.end_at AND f.start < b.end_at)),
w AS (SELECT v, count(DISTINCT source) AS owners FROM a GROUP BY v),
j AS (SELECT a.*, owners, kind || ':' || start || ':' || end_at AS span FROM a JOIN w USING (v)),
g AS (SELECT r, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, o) FILTER (o < 3) AS base, string_agg(span, ',' ORDER BY start, o) FILTER (o < 3 OR owners = 1) AS spans,
  count(*) FILTER (owners = 1) AS n_live, count(*) FILTER (owners >= {secret_scan.EXAMPLE_OWNERS}) AS n_examples FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples
FROM d LEFT JOIN g USING (r)"""


def turn_repair() -> str:
    """The repair as a forward search: the least (cost, audit) per state of the role pattern, turn by turn."""
    space = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    crc = """list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(place) + 1), lambda i: ord(place[i])::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""

    def way(state, cost, letter, line):
        return (f"CASE WHEN {state} IS NOT NULL THEN struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', "
                f"t := {state}.t || {line}) END")

    def least(*ways):
        return f"list_min([w FOR w IN [{', '.join(ways)}] IF w IS NOT NULL])"

    def ins(s, role):
        return way(s, 2, "I", f"chr(10) || '{role}:'")

    def dele(s):
        return way(s, 3, "D", "''")

    def keep(s, ok):
        return f"CASE WHEN NOT gone AND {ok} THEN {way(s, 'short', 'K', 'line')} END"

    def rer(s, role):
        moved = way(s, "2 + short", "R", f"chr(10) || '{role}:' || text")
        return f"CASE WHEN NOT gone THEN {moved} END"

    both = way("s", 4, "II", "chr(10) || 'user:' || chr(10) || 'assistant:'")
    return f"""
WITH RECURSIVE placed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
kinds AS (SELECT *, xor({crc}, 4294967295) % 20 AS kind FROM placed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    rtrim(text, {space}) AS kept FROM damaged),
marked AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again FROM numbered),
faults AS (
  SELECT *, CASE WHEN kept = '' THEN 'blank' WHEN again THEN 'duplicate'
    WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM marked),
turns AS (
  SELECT conv_id, k, initial, text, coalesce(fault IN ('blank', 'duplicate'), false) AS gone,
    CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS short, chr(10) || role || ':' || text AS line FROM faults),
empty AS (SELECT NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS none),
steps AS (
  SELECT conv_id, 0::BIGINT AS k, struct_pack(c := 0::BIGINT, a := '', t := '') AS n, none AS s, none AS u, none AS a
  FROM (SELECT DISTINCT conv_id FROM turns), empty
  UNION ALL
  SELECT z.conv_id, z.k + 1, {dele('z.n')},
    {least(dele('z.s'), keep('z.n', "initial = 's'"))},
    {least(dele('z.u'), *[keep(x, "initial = 'u'") for x in ("z.n", "z.s", "z.a")], *[rer(x, 'user') for x in ("z.n", "z.s", "z.a")])},
    {least(dele('z.a'), keep('z.u', "initial = 'a'"), rer('z.u', 'assistant'))}
  FROM (
    SELECT conv_id, k, n, s, u, {least('a', ins('u', 'assistant'))} AS a
    FROM (SELECT conv_id, k, n, s, {least('u', *[ins(x, 'user') for x in ('n', 's', 'a')])} AS u, a FROM steps)) z
  JOIN turns t ON t.conv_id IS NOT DISTINCT FROM z.conv_id AND t.k = z.k + 1),
ends AS (
  SELECT conv_id, {least('n', 'a', ins('u', 'assistant'), both)} AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS last FROM steps) WHERE last = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM i.conv_id"""


def statements() -> dict[str, str]:
    return {"op1_chat_formatting": chat_formatting(), "op5_mixing": mix(), "op6_decontamination": contamination(),
            "op7_warc": warc(), "op8_secret_scan": secrets(), "op9_ngram_jaccard_join": jaccard(), "op10_license_scan": license_scan(),
            "op12_turn_repair": turn_repair()}
