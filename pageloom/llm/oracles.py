"""DuckDB SQL that gives the same rows as a query, by plain comparison of everything with everything."""

from __future__ import annotations

#: The contract's patterns: kind, pattern, group of the value, its least length; then the kind that the method adds.
_WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_SECRETS = (
    ("assign", rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32), ("owned", "[A-Za-z0-9+/_-]+", 0, 24))
_BASE = ("assign", "access", "hex")

_COMPONENTS = """
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT DISTINCT a AS node, a AS far FROM edges
              UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.far = edges.a),
    groups AS (SELECT node, min(far) AS component_id FROM reach GROUP BY node)"""

JACCARD = rf"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
    each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n AS n, count(*) AS shared FROM each x JOIN each y
              ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 75 * (n - shared)),{_COMPONENTS}
    SELECT doc_id, len(s) AS n_shingles, coalesce(component_id, doc_id) AS component_id
    FROM sets LEFT JOIN groups ON doc_id = node"""

EMBEDDINGS = f"""
    WITH RECURSIVE given AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    able AS (SELECT * FROM given WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
             AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM able x JOIN able y ON x.label = y.label AND x.vec_id < y.vec_id
              AND list_cosine_similarity(x.v, y.v) >= 0.93),{_COMPONENTS},
    counts AS (SELECT a AS vec_id, count(*) AS n FROM edges GROUP BY a)
    SELECT given.vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, given.vec_id) AS component_id,
           given.vec_id = coalesce(component_id, given.vec_id) AS kept
    FROM given LEFT JOIN groups ON given.vec_id = node LEFT JOIN counts ON given.vec_id = counts.vec_id"""


def _kind(no: int) -> str:
    kind, pattern, group, least = _SECRETS[no]
    quoted = "'" + pattern.replace("'", "''") + "'"
    start = "list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)"
    return f"""
    SELECT doc_id, source, {no} AS no, '{kind}' AS kind, ({start})::BIGINT AS begin_at, length(hits[i]) AS n, value[i] AS value FROM (
        SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
            SELECT doc_id, source, regexp_extract_all(t, {quoted}, 0) AS hits, regexp_extract_all(t, {quoted}, {group}) AS value,
                   string_split_regex(t, {quoted}) AS gaps FROM texts)) WHERE length(value[i]) >= {least}"""


def _listed(test: str) -> str:
    return f"coalesce(string_agg(kind || ':' || begin_at || ':' || (begin_at + n), ',' ORDER BY begin_at, no) FILTER (WHERE {test}), '')"


SECRETS = f"""
    WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
    found AS ({" UNION ALL ".join(map(_kind, range(len(_SECRETS))))}),
    owners AS (SELECT value, count(DISTINCT source) + max((source IS NULL)::INT) AS owners FROM found GROUP BY value),
    judged AS (
        SELECT found.*, CASE WHEN owners >= 2 THEN 'example'
            WHEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
                 AND 3 * len(list_distinct(string_split(value, ''))) >= least(length(value), 30) THEN 'live' ELSE 'weak' END AS verdict
        FROM found JOIN owners USING (value)),
    kept AS (SELECT * FROM judged WHERE no < {len(_BASE)} OR verdict = 'live')
    SELECT texts.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _BASE)},
           sha256({_listed(f"no < {len(_BASE)}")}) AS base_sha256, {_listed("no IS NOT NULL")} AS spans,
           count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example
    FROM texts LEFT JOIN kept ON texts.doc_id = kept.doc_id GROUP BY texts.doc_id"""

_TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

DIVERGENCE = f"""
    WITH docs AS (
        SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}') AS w FROM documents),
    each AS (SELECT lang, source, unnest(w) AS term FROM docs),
    often AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= 30),
    counts AS (SELECT lang, source, term, count(*) AS n FROM each JOIN often USING (lang, term) GROUP BY ALL),
    sources AS (SELECT DISTINCT lang, source FROM docs),
    size AS (SELECT lang, count(*) AS v FROM often GROUP BY lang),
    totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
    cells AS (
        SELECT lang, source, term, coalesce(n, 0) AS n,
               1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(total, 0) + 5 * v)::HUGEINT AS p
        FROM sources JOIN often USING (lang) JOIN size USING (lang) LEFT JOIN counts USING (lang, source, term) LEFT JOIN totals USING (lang, source)),
    whole AS (
        SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
        FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) JOIN size USING (lang)),
    pairs AS (
        SELECT x.lang, x.source, y.source AS item, coalesce(f, 0)::BIGINT AS value
        FROM sources x JOIN sources y ON x.lang = y.lang AND x.source <> y.source
        LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM cells a JOIN cells b USING (lang, term) GROUP BY ALL) s
        ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
    terms AS (
        SELECT lang, source, term AS item, (p - q)::BIGINT AS value,
               row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank
        FROM cells JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
    UNION ALL SELECT lang, source, 'term', item, value, rank::INTEGER FROM terms WHERE rank <= 50"""

#: CRC-32 of a number's decimal digits, bit by bit; 3988292384 is the reversed polynomial.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: list_reduce([xor(c, x), 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT],
                             lambda b, y: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END)))"""

PREFIXES = f"""
    WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    named AS (SELECT *, sha256(length(role)::VARCHAR || ':' || role || text) AS name, length(text)::BIGINT AS size FROM given),
    own AS (SELECT conv_id, name, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name) AS pos FROM named),
    convs AS (SELECT conv_id, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own)),
    built AS (
        SELECT convs.conv_id, 0 AS part, pos, name, size FROM convs JOIN own ON own.conv_id = convs.conv_id - convs.conv_id % 100 WHERE pos <= h
        UNION ALL SELECT conv_id, 1, pos, name, size FROM convs JOIN own USING (conv_id) WHERE pos > h),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM built),
    lengths AS (SELECT conv_id, coalesce(max(depth), 0) AS n FROM convs LEFT JOIN placed USING (conv_id) GROUP BY conv_id),
    through AS (
        SELECT conv_id, depth, size, string_agg(name, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM placed
        UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
    nodes AS (
        SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved,
               coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends
        FROM through JOIN lengths USING (conv_id) GROUP BY path, depth),
    children AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
    full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
    sums AS (
        SELECT x.path, count(*) FILTER (WHERE y.n_children = 0) AS n_leaves, sum(y.saved)::BIGINT AS saved_tokens
        FROM full_nodes x JOIN full_nodes y ON starts_with(y.path, x.path) GROUP BY x.path)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
    FROM full_nodes n JOIN sums USING (path) LEFT JOIN full_nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 64)"""
