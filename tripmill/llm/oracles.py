"""SQL of the queries that SQL can express, for the other engine."""

from __future__ import annotations

from tripmill.llm import chat, divergence, secret_scan


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def escaped(text: str) -> str:
    """The template's escaping as nested replacements."""
    found = f"replace({text}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        found = f"replace({found}, {quoted(control)}, {quoted(control[0] + chr(92) + control[1:])})"
    return found


def chat_parts(hostile: str) -> str:
    marks = len(chat.TURN + chat.BODY + chat.END)
    order = "ORDER BY turn, role, text"
    loss = f"FILTER (WHERE role = '{chat.LOSS_ROLE}')"
    return f"""
WITH given AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {quoted(hostile)}
  UNION ALL SELECT -7, 1, 'assistant', {quoted(hostile)}
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) {loss}, 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) {loss}, '')) AS loss_sha256,
  CAST(sum({marks} + length({escaped("role")}) + length({escaped("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def secret_ownership() -> str:
    kinds = [(name, pattern) for name, pattern, _, _ in secret_scan.BASE_KINDS]
    # Greedy runs start leftmost anyway; the look-behind only spares work.
    kinds.append((secret_scan.OWNED, secret_scan.OWNED_PATTERN.split(")", 1)[1]))
    least = [k[3] for k in secret_scan.BASE_KINDS] + [0]
    scans = " UNION ALL ".join(
        f"SELECT doc_id, source, {rank} AS rank, regexp_extract_all(text, {quoted(p)}) AS hits, "
        f"string_split_regex(text, {quoted(p)}) AS gaps FROM texts"
        for rank, (_, p) in enumerate(kinds)
    )
    assign = quoted(kinds[0][1])
    names = "[" + ", ".join(quoted(name) for name, _ in kinds) + "]"
    line = f"string_agg({names}[rank + 1] || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop)"
    owned = len(kinds) - 1
    return f"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
scans AS ({scans}),
listed AS (
  SELECT doc_id, source, rank, unnest(generate_series(1, len(hits))) AS nth, unnest(hits) AS hit,
    unnest(gaps[1:len(hits)]) AS gap
  FROM scans WHERE len(hits) > 0
), places AS (
  SELECT doc_id, source, rank, hit,
    sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY nth) AS stop
  FROM listed
), found AS (
  SELECT *, CAST(stop - length(hit) AS BIGINT) AS start,
    CASE WHEN rank = 0 THEN regexp_extract(hit, {assign}, 2) ELSE hit END AS value
  FROM places
), spans AS (
  SELECT * FROM found WHERE length(value) >= {list(least)}[rank + 1] AND (rank < {owned} OR (
    regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND len(list_distinct(string_split(value, ''))) >= {secret_scan.DIFFERENT_LETTERS}))
), holders AS (
  SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners,
    count(DISTINCT coalesce('=' || source, '') || ' ' || doc_id) AS repositories
  FROM spans GROUP BY value
), judged AS (
  SELECT spans.*, owners <= {secret_scan.LIVE_OWNERS}
    AND repositories <= {secret_scan.LIVE_REPOSITORIES} AS live
  FROM spans JOIN holders USING (value)
), kept AS (
  SELECT * FROM judged AS j WHERE rank < {owned} OR (live AND NOT EXISTS (
    SELECT 1 FROM judged AS b WHERE b.doc_id = j.doc_id AND b.rank < {owned}
      AND b.start < j.stop AND j.start < b.stop))
), per_doc AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE rank = {k}) AS n_{name}" for k, (name, _) in enumerate(kinds))},
    {line} FILTER (WHERE rank < {owned}) AS base_text, {line} AS spans,
    count(*) FILTER (WHERE rank < {owned} AND live) AS n_live,
    count(*) FILTER (WHERE rank < {owned} AND NOT live) AS n_copied
  FROM kept GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name, _ in kinds)},
  sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM documents LEFT JOIN per_doc USING (doc_id)
"""


def source_divergence() -> str:
    scale, least = divergence.SCALE, divergence.LEAST_DOCUMENTS
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{letters}', '{letters.lower()}') AS text FROM documents
), numbered AS (
  SELECT row_number() OVER () AS nr, lang, source, regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM docs
), words AS (SELECT nr, lang, source, unnest(terms) AS term FROM numbered),
kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words
  GROUP BY lang, term HAVING count(DISTINCT nr) >= {least}
), languages AS (SELECT lang, sum(n) AS mass, count(*) AS v FROM kept GROUP BY lang),
counts AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM words SEMI JOIN kept USING (lang, term)
  GROUP BY lang, source, term
), masses AS (SELECT lang, source, sum(n) AS mass FROM counts GROUP BY lang, source),
groups AS (
  SELECT lang, source, coalesce(masses.mass, 0) AS mass, v
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN masses USING (lang, source) LEFT JOIN languages USING (lang)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({scale}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.mass + g.v) AS p,
    1 + ({scale}::HUGEINT * (k.n + 1)) // (l.mass + l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN languages l ON l.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), listed AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM listed
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TERM_RANKS}
"""


def conversation_trie(modulus: int = 100, most: int = 6) -> str:
    # crc32 of the decimal digits, bit by bit: a byte is met with an exclusive or, then shifted out.
    bits = "[ascii(digit), -1, -1, -1, -1, -1, -1, -1, -1]"
    step = "CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END"
    steps = f"flatten(list_transform(string_split(CAST(conv AS VARCHAR), ''), lambda digit: {bits}))"
    crc = f"xor(list_reduce(list_transform({steps}, lambda x: CAST(x AS BIGINT)), lambda acc, x: {step}, 4294967295), 4294967295)"
    return f"""
WITH turns AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv, {crc} % {most} AS h, conv - conv % {modulus} AS base FROM (SELECT DISTINCT conv FROM turns)
), heads AS (SELECT c.conv, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv = c.base AND t.pos <= c.h),
taken AS (SELECT conv, count(*) AS taken FROM heads GROUP BY conv),
rebuilt AS (
  SELECT * FROM heads UNION ALL
  SELECT t.conv, t.pos - c.h + coalesce(n.taken, 0), t.role, t.text
  FROM turns t JOIN convs c USING (conv) LEFT JOIN taken n USING (conv) WHERE t.pos > c.h
), chains AS (
  SELECT conv, pos AS depth, length(text) AS chars,
    md5(string_agg(CAST(to_json([role, text]) AS VARCHAR), ',') OVER (PARTITION BY conv ORDER BY pos)) AS key
  FROM rebuilt
), prefixes AS (
  SELECT conv, depth, chars, key FROM chains UNION ALL SELECT conv, 0, 0, '' FROM convs
), steps AS (
  SELECT *, lag(key) OVER (PARTITION BY conv ORDER BY depth) AS above,
    depth = max(depth) OVER (PARTITION BY conv) AS is_end FROM prefixes
), members AS (
  SELECT key, any_value(depth) AS depth, any_value(above) AS above, min(conv) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * any_value(chars) AS own,
    sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM steps GROUP BY key
), children AS (SELECT above AS key, count(*) AS n_children FROM members WHERE above IS NOT NULL GROUP BY above),
below AS (
  SELECT DISTINCT a.key, b.key AS lower FROM prefixes a JOIN prefixes b ON a.conv = b.conv AND a.depth <= b.depth
), summed AS (
  SELECT b.key, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum(m.own) AS saved_tokens
  FROM below b JOIN members m ON m.key = b.lower LEFT JOIN children c ON c.key = b.lower GROUP BY b.key
)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n_convs,
  coalesce(c.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM members m JOIN summed s USING (key) LEFT JOIN children c USING (key) LEFT JOIN members u ON u.key = m.above
"""
