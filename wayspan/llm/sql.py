"""DuckDB SQL twins of the training-data queries."""

from wayspan.llm import line_rules

OP3 = """
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER w AS n, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS k
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''))
), c AS (
  SELECT conv_id, list(struct_pack(role := role, text := text, k := k) ORDER BY n) AS turns,
         coalesce(list(text ORDER BY n) FILTER (role = 'assistant'), []) AS said
  FROM o GROUP BY conv_id
), j AS (
  SELECT x.conv_id, x.turns, len(x.said) // 2 AS half, coalesce(y.said, []) AS other
  FROM c x LEFT JOIN c y ON xor(x.conv_id, 1) = y.conv_id
), p AS (
  SELECT conv_id, list_transform(turns, lambda t: struct_pack(role := t.role, text := t.text)) AS c,
         list_transform(list_filter(turns, lambda t: t.role <> 'assistant' OR t.k <= half OR t.k <= len(other)),
           lambda t: struct_pack(role := t.role, text := CASE WHEN t.role = 'assistant' AND t.k > half THEN other[CAST(t.k AS BIGINT)] ELSE t.text END)) AS r
  FROM j
), n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, len(c)) AS n FROM p
), s AS (
  SELECT conv_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM n
), t AS (
  SELECT *, list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS ct,
            list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS rt,
            list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS pt
  FROM s
)
SELECT conv_id, CAST(n AS INTEGER) AS n_prompt_turns,
       array_to_string(pt, '') AS prompt, array_to_string(ct, '') AS chosen, array_to_string(rt, '') AS rejected,
       array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'),
         lambda i: CAST(coalesce(list_sum(list_transform(ct[1:i - 1], lambda x: length(x))), 0) + length(c[i].role) + 5 AS BIGINT) || ':' || (length(c[i].text) + 8)), ',') AS chosen_mask,
       array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'),
         lambda i: CAST(coalesce(list_sum(list_transform(rt[1:i - 1], lambda x: length(x))), 0) + length(r[i].role) + 5 AS BIGINT) || ':' || (length(r[i].text) + 8)), ',') AS rejected_mask,
       len(c) = 0 AND len(r) = 0 AS identical
FROM t
"""

OP6 = """
WITH p AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (
  SELECT u.page_id, r.h || r.p AS rule, r.v,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC, length(r.h) DESC) AS k
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM u LEFT JOIN f ON u.page_id = f.page_id AND f.k = 1
"""



def _op11(k: int = 8, rounds: int = 10) -> str:
    """The rounds one after the other; a vector's nearest centroid is the least of distance * k + number."""
    parts = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        "e AS MATERIALIZED (SELECT rid, unnest(range(64)) AS dim, unnest(v) AS x FROM kept)",
        f"first AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL ORDER BY c LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS dim, unnest(v) AS m FROM first)",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, min(d * {k} + c) AS dc FROM (SELECT rid, c, sum((x - m) * (x - m)) AS d FROM e JOIN c{r} USING (dim) GROUP BY rid, c) GROUP BY rid)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT dc % {k} AS c, dim, sum(x) AS s, count(*) AS n FROM e JOIN a{r} USING (rid) GROUP BY ALL)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, o.dim, CASE WHEN n IS NULL THEN m ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS m FROM c{r} o LEFT JOIN s{r} USING (c, dim))")
    parts.append(f"named AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(dc % {k} AS INTEGER) AS cluster, CAST(dc // {k} AS BIGINT) AS distance,
       CAST(sum(dc // {k}) OVER (PARTITION BY dc % {k}) AS BIGINT) AS cluster_inertia, CAST(sum(dc // {k}) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN named ON named.c = dc % {k}
"""
    )


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(values: tuple[str, ...] | str) -> str:
    return "(" + ", ".join(map(_text, values)) + ")"


_BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS MATERIALIZED (
  SELECT rid, line, {_WORDS.format("line")} AS ws, {_LOWER.format("line")} AS low, length(translate(line, {_BLANKS}, '')) AS chars
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
), n AS (
  SELECT *, len(ws) AS n, len(list_filter(ws, lambda w: w IN {_any(line_rules.SEPARATORS)})) AS seps, len(list_filter(ws, lambda w: right(w, 1) IN ('!', '?'))) AS loud,
         length(line) - length(translate(line, '{line_rules.SYMBOLS}', '')) AS syms
  FROM l WHERE len(ws) > 0
), r AS (
  SELECT *, CASE
    WHEN seps >= 3 AND 4 * seps >= n OR trim(translate(low, '.:>»…›|' || {_BLANKS}[2:], '')) IN {_any(line_rules.LABELS)} THEN 'navigation'
    WHEN n <= {line_rules.SHORT} AND regexp_matches(low, {_text("|".join(line_rules.PHRASES))}) THEN 'boilerplate'
    WHEN 100 * syms > {line_rules.MOST_SYMBOLS} * chars THEN 'symbols'
    WHEN right(rtrim(line, {_text(line_rules.AFTER)} || {_BLANKS}), 1) NOT IN {_any(line_rules.CLOSING)} AND (n <= {line_rules.SHORT} OR len(list_filter(ws, lambda w: right(w, 1) IN {_any(line_rules.CLOSING)})) = 0)
      OR 2 * loud > n THEN 'punctuation' END AS rule
  FROM n
), by_doc AS (
  SELECT rid, sum(chars) AS chars, sum(syms) AS syms, count(*) - count(DISTINCT line) AS dup, coalesce(sum(chars) FILTER (rule IS NOT NULL), 0) AS lost,
         count(*) FILTER (rule = 'navigation') AS nav, count(*) FILTER (rule = 'boilerplate') AS boil, count(*) FILTER (rule = 'symbols') AS sym, count(*) FILTER (rule = 'punctuation') AS punct
  FROM r GROUP BY rid
), w AS MATERIALIZED (SELECT rid, {_WORDS.format("t")} AS ws FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS gram FROM w WHERE len(ws) >= {line_rules.RUN}),
again AS (SELECT rid, unnest(places) AS i FROM (SELECT rid, list(i) AS places FROM g GROUP BY rid, gram HAVING count(*) > 1)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {line_rules.RUN})) AS p FROM again) GROUP BY rid),
f AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(coalesce(syms, 0) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars, CAST(coalesce(nav, 0) AS BIGINT) AS n_navigation, CAST(coalesce(boil, 0) AS BIGINT) AS n_boilerplate,
         CAST(coalesce(sym, 0) AS BIGINT) AS n_symbol_lines, CAST(coalesce(punct, 0) AS BIGINT) AS n_punctuation
  FROM d JOIN w USING (rid) LEFT JOIN by_doc USING (rid) LEFT JOIN rep USING (rid)
), b AS (SELECT *, n_words < {line_rules.LEAST_WORDS} OR 100 * n_repeat_words > {line_rules.MOST_REPEATED} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND 100 * lost_chars <= {line_rules.MOST_LOST} * word_chars AS kept FROM b
"""

ORACLE = {"op12_line_rules": OP12, "op3_preferences": OP3, "op6_url_rules": OP6, "op11_sort_means": _op11()}
