"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_RULES = ("few_words", "repeats", "symbols", "dup_lines")


def quality_sql(source: str = "documents", limit: float = 0.6) -> str:
    """CTEs up to `judged`: the rows of op1 with id, host and verdict."""
    rates = ", ".join(f"CASE WHEN v_{r} > 0 THEN (f_{r} + m_{r} * greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 0)) / (host_docs + greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 0)) ELSE m_{r} END AS r_{r}" for r in _RULES)
    return rf"""
q_docs AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text, {_WORDS} AS ws FROM {source}),
q_win AS (SELECT rid, i, array_to_string(ws[i : i + 7], ' ') AS win FROM q_docs, unnest(range(1, greatest(len(ws) - 6, 1))) AS u(i)),
q_rep AS (SELECT rid, i FROM q_win QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
q_cover AS (SELECT rid, sum(n) AS n FROM (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS n FROM q_rep) GROUP BY rid),
q_line AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM q_docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
q_dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM q_line GROUP BY rid),
q_base AS (SELECT d.rid, doc_id, host, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM q_docs d LEFT JOIN q_cover c USING (rid) LEFT JOIN q_dup l USING (rid)),
q_fail AS (SELECT *, n_words < 20 AS few_words, 100 * n_repeat_words > 30 * n_words AS repeats, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS dup_lines FROM q_base),
q_host AS (SELECT host, count(*) AS host_docs, {", ".join(f"count(*) FILTER (WHERE {r}) AS f_{r}" for r in _RULES)} FROM q_fail GROUP BY host),
q_prior AS (SELECT {", ".join(f"avg(f_{r} / host_docs) AS m_{r}, var_pop(f_{r} / host_docs) AS v_{r}" for r in _RULES)} FROM q_host),
q_rate AS (SELECT host, {rates} FROM q_host, q_prior),
judged AS (SELECT q_fail.*, few_words OR repeats AS base_failed, NOT (few_words OR repeats) AND NOT greatest({", ".join("r_" + r for r in _RULES)}) > {limit} AS kept, {", ".join(f"round(r_{r}, 9) AS rate_{r}" for r in _RULES)}
  FROM q_fail JOIN q_rate ON q_fail.host IS NOT DISTINCT FROM q_rate.host)"""


OP1 = f"WITH {quality_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, {', '.join('rate_' + r for r in _RULES)} FROM judged"


def near_dup_sql(source: str = "documents") -> str:
    """Recursive CTEs up to `components` (doc_id, n_shingles, component_id); doc_id must be unique."""
    words = _WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    return rf"""
n_docs AS (SELECT doc_id, {words} AS ws FROM {source}),
n_sets AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM n_docs, unnest(range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - 3, 2) END)) AS u(i)),
n_size AS (SELECT doc_id, count(*) AS n FROM n_sets GROUP BY doc_id),
n_common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM n_sets a JOIN n_sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
n_link AS (SELECT a, b FROM n_common JOIN n_size x ON x.doc_id = a JOIN n_size y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
n_reach AS (SELECT doc_id AS node, doc_id AS seen FROM n_docs UNION SELECT r.node, l.b FROM n_reach r JOIN n_link l ON r.seen = l.a),
components AS (SELECT d.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(r.seen) AS component_id FROM n_docs d JOIN n_reach r ON r.node = d.doc_id LEFT JOIN n_size z ON z.doc_id = d.doc_id GROUP BY d.doc_id)"""


OP9 = f"WITH RECURSIVE {near_dup_sql()} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM components"


OP4 = rf"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS win FROM d, unnest(range(1, greatest(len(ws) - 48, 1))) AS u(i)),
f AS (SELECT doc_id, i FROM w QUALIFY min(doc_id) OVER (PARTITION BY win) < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM f, range(50) AS r(k)),
kept AS (SELECT d.doc_id, p, ws[p] AS word FROM d, unnest(range(1, len(ws) + 1)) AS u(p) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = d.doc_id AND g.p = u.p)),
text AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN text USING (doc_id)"""


def _found(kind: str, rank: int, regex: str, group: int, least: int, source: str) -> str:
    return f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, start, start + length(m) AS stop FROM (
  SELECT rid, m[i] AS m, g[i] AS g, coalesce(list_sum(list_transform(p[1 : i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT rid, regexp_extract_all(text, $r${regex}$r$) AS m, regexp_extract_all(text, $r${regex}$r$, {group}) AS g, string_split_regex(text, $r${regex}$r$) AS p FROM {source}), unnest(range(1, len(m) + 1)) AS u(i)) WHERE length(g) >= {least}"""


_ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = (
    ("assign", _ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("maps", "AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("jwt", "eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}", 0, 1),
)


def secret_sql(source: str = "documents") -> str:
    """CTEs up to s_spans (rid, rank, kind, start, stop); s_docs has rid, doc_id, text."""
    return f"""
s_docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {source}),
s_spans AS ({" UNION ALL ".join(_found(k, n, x, g, m, "s_docs") for n, (k, x, g, m) in enumerate(_SECRETS))})"""


OP8 = f"""WITH {secret_sql()}
SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank <= 2), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
FROM s_docs LEFT JOIN s_spans USING (rid) GROUP BY rid, doc_id"""


_TURN = r"replace(replace(role, '\', '\\'), '|', '\|')"
_SAID = r"replace(replace(text, '\', '\\'), '<|', '<\|')"
OP6 = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(13 + length({_TURN}) + length({_SAID}))::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role IN ('user', 'tool') ELSE role IN ('assistant', 'tool') END) AS valid
FROM s GROUP BY conv_id"""


_LETTER = " + ".join(f"{16 >> k} * (bits[5 * i + {k + 1}] = '1')::INT" for k in range(5))
OP11 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, unhex(sha1(html))::BIT::VARCHAR AS bits FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + {_LETTER}]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def _encoded(field: str) -> str:
    return f"CASE WHEN {field} IS NULL THEN '-' ELSE octet_length(encode({field}::VARCHAR)) || ':' || {field}::VARCHAR END"


def _leaf(chars: str) -> str:
    return "sha256(" + " || ".join(_encoded(f) for f in ("doc_id", "source", "lang", chars, "text")) + ")"


def _tree(name: str, rows: str, levels: int) -> str:
    """CTEs over rows (rid, g, idx, n, h, folded): {name}_h (g, h): the roots; {name}_d (rid, proof, folded)."""
    steps = [f"{name}_h0 AS MATERIALIZED (SELECT g, idx, n, h FROM {rows}), {name}_d0 AS MATERIALIZED (SELECT rid, g, idx AS i, '' AS proof, folded FROM {rows})"]
    for k in range(levels):
        steps.append(f"""{name}_d{k + 1} AS MATERIALIZED (SELECT rid, d.g, i // 2 AS i, proof || coalesce(s.h, '') AS proof,
    CASE WHEN o.n > 1 THEN sha256(CASE WHEN i % 2 = 1 THEN s.h ELSE '' END || folded || CASE WHEN i % 2 = 0 THEN coalesce(s.h, '') ELSE '' END) ELSE folded END AS folded
    FROM {name}_d{k} d JOIN {name}_h{k} o ON o.g = d.g AND o.idx = d.i LEFT JOIN {name}_h{k} s ON s.g = d.g AND s.idx = xor(d.i, 1)),
  {name}_h{k + 1} AS MATERIALIZED (SELECT g, idx // 2 AS idx, (any_value(n) + 1) // 2 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE any_value(h) END AS h FROM {name}_h{k} GROUP BY g, idx // 2)""")
    return ", ".join(steps) + f", {name}_h AS (SELECT g, h FROM {name}_h{levels}), {name}_d AS (SELECT rid, proof, folded FROM {name}_d{levels})"


#: A step of the reflected polynomial of crc32 for a bit.
_BITS = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)"
_CRC = f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: {_BITS}))"
OP12 = f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, {_leaf("n_chars")} AS h, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS folded FROM documents),
inner_rows AS MATERIALIZED (SELECT rid, doc_id, h, folded, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM docs),
{_tree("inner", "inner_rows", 18)},
outer_rows AS MATERIALIZED (SELECT rid, 0 AS g, r.g AS idx, (SELECT count(*) FROM inner_h) AS n, o.h, d.folded FROM inner_rows r JOIN inner_h o USING (g) JOIN inner_d d USING (rid)),
tops AS MATERIALIZED (SELECT DISTINCT 0 AS g, idx, n, h FROM outer_rows),
{_tree("outer", "outer_rows", 6).replace("SELECT g, idx, n, h FROM outer_rows", "SELECT g, idx, n, h FROM tops")}
SELECT doc_id, r.h AS leaf, o.h AS subroot, t.h AS root, sha256(i.proof || d.proof) AS proof_sha256, d.folded AS folded_root, d.folded = t.h AS verified
FROM inner_rows r JOIN inner_h o USING (g) JOIN inner_d i USING (rid) JOIN outer_d d USING (rid) CROSS JOIN outer_h t"""


def _clusters(k: int, rounds: int, dimension: int) -> str:
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimension})""", f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v AS w FROM kept ORDER BY sha256('2:' || vec_id) LIMIT {k})"]
    for r in range(rounds + 1):
        steps.append(f"far{r} AS (SELECT rid, vec_id, v, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept CROSS JOIN c{r}), a{r} AS MATERIALIZED (SELECT rid, vec_id, any_value(v) AS v, arg_min(c, row(d, c)) AS c, min(d) AS d FROM far{r} GROUP BY rid, vec_id)")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT c, pos, sum(v[pos]) AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, {dimension + 1}) AS u(pos) GROUP BY c, pos),
w{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY pos)::BIGINT[] AS w FROM m{r} GROUP BY c), c{r + 1} AS MATERIALIZED (SELECT c0.c, coalesce(w{r}.w, c0.w) AS w FROM c{r} c0 LEFT JOIN w{r} ON w{r}.c = c0.c)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


OP13 = _clusters(40, 5, 64)
