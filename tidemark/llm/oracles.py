"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

from tidemark.llm.delta_lloyd import Lloyd
from tidemark.llm.fill_in_middle import MIDDLE, PREFIX, SUFFIX, Form
from tidemark.llm.queries import MIX, MIX_BLOCK, URL_LIST_DOMAINS, URL_LIST_NAMES, URL_LIST_PAGES, URL_RULES


def _period(parts: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, ordinal, slot) of one period, slot by slot."""
    total, done, out = sum(parts.values()), dict.fromkeys(sorted(parts), 0), []
    for slot in range(total):
        free = [s for s in done if done[s] * total // parts[s] <= slot]
        first = min(free, key=lambda s: -(-(done[s] + 1) * total // parts[s]))
        out.append((first, done[first], slot))
        done[first] += 1
    return out


def _mixing() -> str:
    total = sum(MIX.values())
    named = ", ".join(f"'{s}'" for s in MIX if s != "*")
    parts = ", ".join(f"('{s}', {a})" for s, a in MIX.items())
    slots = ", ".join(f"('{s}', {k}, {t})" for s, k, t in _period(MIX))
    return f"""
    WITH parts(grp, a) AS (VALUES {parts}), slots(grp, ordinal, taken) AS (VALUES {slots}),
    d AS (SELECT doc_id, CASE WHEN source IN ({named}) THEN source ELSE '*' END AS grp, greatest(coalesce(n_chars, 1), 1) AS units FROM documents),
    k AS (SELECT *, md5(coalesce(doc_id::varchar, '') || '|' || units::varchar) AS key FROM d),
    b AS (SELECT doc_id, grp, coalesce(sum(units) OVER (PARTITION BY grp ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint // {MIX_BLOCK} AS block FROM k)
    SELECT doc_id, grp, block, (block * {total}) // a AS release, ((block + 1) * {total} + a - 1) // a AS deadline,
           (block // a) * {total} + taken AS slot
    FROM b JOIN parts USING (grp) JOIN slots USING (grp) WHERE ordinal = block % a
    """


def _urls() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    hosts = ", ".join(f"('{n}.{d}', '')" for n in URL_LIST_NAMES for d in URL_LIST_DOMAINS)
    return f"""
    WITH rules(rh, rp, rv) AS (VALUES {rules}),
    listed(lh, lp) AS (SELECT * FROM (VALUES {hosts}) UNION ALL SELECT 'host' || (k % 1000) || '.example.com', '/listed/' || k FROM range({URL_LIST_PAGES}) t(k)),
    r AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    u AS (SELECT page_id, row_number() OVER () AS n,
                 translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    c AS (SELECT n, string_split(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', ''), '.') AS labels,
                 list_filter(string_split(url_decode(replace(path, '+', '%2B')), '/'), lambda x: x <> '' AND x <> '.') AS segments FROM u),
    k AS (SELECT n, array_to_string(labels[i:], '.') AS lh, CASE WHEN j = 0 THEN '' ELSE '/' || array_to_string(segments[:j], '/') END AS lp
          FROM (SELECT n, labels, segments, i, unnest(range(0, len(segments) + 1)) AS j FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM c))),
    l AS (SELECT n, arg_max(lh || lp, length(lh) + length(lp)) AS entry FROM k JOIN listed USING (lh, lp) GROUP BY n),
    f AS (SELECT n, arg_max({{'rule': rh || rp, 'verdict': rv}}, length(rh) + length(rp)) AS hit
          FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
    SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, CASE WHEN entry IS NOT NULL THEN 'block' END, 'allow') AS verdict, entry,
           CASE WHEN hit IS NOT NULL THEN 'rule' WHEN entry IS NOT NULL THEN 'list' END AS "by"
    FROM u LEFT JOIN f USING (n) LEFT JOIN l USING (n)
    """


#: Terms as lower-cased runs of letters and digits; counts of n-grams by windows, the row's own ones taken off.
_LM = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
    t AS (SELECT r, i, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS p, CASE WHEN i > 2 THEN w[i - 2] END AS q FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
    c AS (SELECT r, i, count(*) OVER () AS n, count(*) OVER (PARTITION BY r) AS own,
                 count(*) OVER (PARTITION BY x) - count(*) OVER (PARTITION BY r, x) AS c1,
                 CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY i > 1, p, x) - count(*) OVER (PARTITION BY r, i > 1, p, x) ELSE 0 END AS c2,
                 CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY i > 2, q, p, x) - count(*) OVER (PARTITION BY r, i > 2, q, p, x) ELSE 0 END AS c3 FROM t),
    b AS (SELECT *, lag(c1) OVER (PARTITION BY r ORDER BY i) AS b1, lag(c2) OVER (PARTITION BY r ORDER BY i) AS b2 FROM c),
    s AS (SELECT r, count(*) AS n_terms, sum(CASE WHEN c3 > 0 THEN ln(c3 / b2) WHEN c2 > 0 THEN ln(c2 / b1) + ln(0.4)
                 WHEN c1 > 0 THEN ln(c1 / greatest(n - own, 1)) + 2 * ln(0.4) ELSE 3 * ln(0.4) - ln(greatest(n - own, 1)) END) AS log_score FROM b GROUP BY r)
    SELECT doc_id, coalesce(n_terms, 0) AS n_terms, round(coalesce(log_score, 0), 4) + 0.0::double AS log_score, round(log_score / n_terms, 6) + 0.0::double AS mean_log FROM d LEFT JOIN s USING (r)
"""


#: Equal lines by their first occurrence; lines of five words and more within one word of an earlier one: by what is left without a word.
_LINES = r"""
    WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, line_no, doc_id * 1000000 + line_no AS place, trim(regexp_replace(raw, '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS line FROM t WHERE regexp_matches(raw, '[^\x20\x09\x0B-\x0D]')),
    f AS (SELECT line, min(place) AS first, string_split(line, ' ') AS w FROM l GROUP BY line),
    s AS (SELECT line, first, w, len(w) AS n FROM f WHERE len(w) >= 5),
    m AS (SELECT line, first, n, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM s)),
    near AS (SELECT line FROM m QUALIFY min(first) OVER (PARTITION BY n, i, rest) < first
             UNION SELECT CASE WHEN m.first < s.first THEN s.line ELSE m.line END FROM m JOIN s ON s.line = m.rest)
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(len(removed), 0) AS n_removed, coalesce(removed, []) AS removed FROM documents d LEFT JOIN (
      SELECT l.doc_id, count(*) AS n_lines, list(l.line_no::int ORDER BY l.line_no) FILTER (l.place <> f.first OR near.line IS NOT NULL) AS removed
      FROM l JOIN f USING (line) LEFT JOIN near ON near.line = l.line GROUP BY 1) USING (doc_id)
"""


def _fim(how: Form = Form()) -> str:
    """Units by a pattern, cut by list slices; what is rebuilt is the text itself."""
    draw = lambda k: f"('0x' || substr(seed, {8 * k + 1}, 8))::bigint"
    marked = " OR ".join(f"contains(t, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{how.salt}' || coalesce(doc_id::varchar, '')) AS seed FROM documents),
    u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, {draw(0)} AS h1, {draw(1)} AS h2, {draw(2)} AS h3, {draw(3)} AS h4 FROM d),
    f AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                 CASE WHEN t = '' OR {marked} OR h3 % 100 >= {how.moved} THEN 'plain' WHEN h4 % 100 < {how.spm} THEN 'spm' ELSE 'psm' END AS form FROM u),
    c AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE t END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM c
    """


def _lloyd(how: Lloyd = Lloyd()) -> str:
    """Every round over all vectors and centroids, by components."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({how.scale} * x::double)::bigint) AS q FROM embeddings
            WHERE len(embedding) = {how.dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {how.dims})""",
        f"e AS MATERIALIZED (SELECT r, i, q[i] AS x FROM (SELECT r, q, unnest(range(1, {how.dims} + 1)) AS i FROM v))",
        f"""c0 AS MATERIALIZED (SELECT k, i, q[i] AS y FROM (SELECT k, q, unnest(range(1, {how.dims} + 1)) AS i FROM
            (SELECT row_number() OVER (ORDER BY sha256('{how.salt}' || vec_id)) - 1 AS k, q FROM v) WHERE k < {how.clusters}))""",
    ]
    for t in range(how.rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, k, d FROM (SELECT r, k, sum((x - y) * (x - y))::bigint AS d FROM e JOIN c{t} USING (i) GROUP BY r, k) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if t < how.rounds:
            parts.append(f"""c{t + 1} AS MATERIALIZED (SELECT k, i, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{t} LEFT JOIN
                (SELECT k, i, sum(x)::bigint AS s, count(*) AS n FROM e JOIN a{t} USING (r) GROUP BY k, i) USING (k, i))""")
    last = how.rounds
    return f"""WITH {", ".join(parts)},
    h AS (SELECT k, sha256(string_agg(y::varchar, ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY k)
    SELECT vec_id, k::int AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::bigint AS cluster_inertia, sum(d) OVER ()::bigint AS inertia, centroid_sha256
    FROM a{last} JOIN v USING (r) JOIN h USING (k)
    """


ORACLES = {
    "op1_lm_scoring": _LM,
    "op6_mixing": _mixing(),
    "op7_line_dedup": _LINES,
    "op9_url_filter": _urls(),
    "op12_fill_in_middle": _fim(),
    "op13_delta_lloyd": _lloyd(),
}
