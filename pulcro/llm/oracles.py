"""SQL that the queries must equal, where SQL can say it."""

ORACLES = {
    "op7_topk_search": """
WITH q AS (
    SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.r, a.vec_id AS query_id, b.vec_id, b.r AS o,
        list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM q a JOIN q b ON a.r <> b.r
    WHERE a.vec_id % 20 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, o) AS k
    FROM scored
)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM ranked WHERE k <= 20
""",
    "op8_line_dedup": r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
    FROM documents
), l AS (
    SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d
), k AS (
    SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS key
    FROM l
), f AS (
    SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
    SELECT k.r, k.doc_id, k.line, k.place,
        f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.keeper AS gone
    FROM k LEFT JOIN f ON k.key = f.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
    count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
""",
}


def _draw(path: str, weight: str) -> str:
    return (
        f"-ln((('0x' || substr(md5({path} || '|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT"
        f" + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / {weight}"
    )


def _descend(tree: list[tuple[int, int, int]]) -> str:
    """SQL of the shard of a row: three levels, each takes the child with the least draw."""
    paths = [("t", *map(str, leaf)) for leaf in tree]
    at = "'t'"
    for level in (2, 3, 4):
        weights: dict[str, int] = {}
        for p in paths:
            weights["/".join(p[:level])] = weights.get("/".join(p[:level]), 0) + 1
        table = "MAP {" + ", ".join(f"'{p}': {w}::DOUBLE" for p, w in weights.items()) + "}"
        options = ", ".join(
            f"{{'d': {_draw(f'(up || {chr(39)}/{c}{chr(39)})', f'{table}[up || {chr(39)}/{c}{chr(39)}]')},"
            f" 'p': up || '/{c}'}}"
            for c in sorted({p.rsplit("/", 1)[1] for p in weights})
        )
        at = (
            f"list_transform([{at}], lambda up: list_min(list_filter([{options}], lambda o: o.d IS NOT NULL)))[1].p"
        )
    numbers = "MAP {" + ", ".join(f"'{'/'.join(p)}': {k}" for k, p in enumerate(paths)) + "}"
    return f"({numbers}[{at}])"


def _crc_table() -> str:
    """The table of CRC-32: eight halvings of each byte with the reflected polynomial."""
    halving = "xor(c >> 1, (c & 1) * 3988292384)"
    entry = "b"
    for _ in range(8):
        entry = halving.replace("c", f"({entry})") if entry == "b" else f"list_transform([{entry}], lambda c: {halving})[1]"
    return f"list_transform(range(256), lambda b: {entry})"


def _crc_of_number(number: str) -> str:
    """CRC-32 of the decimal text of a number, with the table ``t.crc``."""
    codes = f"list_transform(string_split({number}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    return (
        f"xor(4294967295, list_reduce(list_concat([4294967295], {codes}), "
        "lambda c, x: xor(c >> 8, t.crc[1 + (xor(c, x) & 255)])))"
    )


def _sharding() -> str:
    def tree(n: int) -> list[tuple[int, int, int]]:
        return [(k // 8, k // 4 % 2, k % 4) for k in range(n)]

    return f"""
WITH t AS (SELECT {_crc_table()} AS crc),
d AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
        xor(4294967295, list_reduce(
            list_concat([4294967295], list_transform(
                string_split_regex(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' '),
                lambda h: CASE WHEN h = '' THEN -1 ELSE ('0x' || h)::BIGINT END)),
            lambda c, x: CASE WHEN x < 0 THEN c ELSE xor(c >> 8, t.crc[1 + (xor(c, x) & 255)]) END)) AS text_crc32,
        {_descend(tree(24))}::INTEGER AS shard, {_descend(tree(25))}::INTEGER AS grown_shard
    FROM documents, t
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
    grown_shard
FROM d
"""


ORACLES["op4_sharding"] = _sharding()


def _secrets() -> str:
    def q(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    # The base patterns, written out once more; the last column is the group and its least length.
    keyword, value = "(?i:password|passwd|secret|token|api_?key)", "[A-Za-z0-9+/_.=-]+"
    assign = "(" + keyword + ")[\"']?\\x20*[:=]\\x20*[\"']?(" + value + ")"
    kinds = (
        (0, "assign", assign, f"length(regexp_extract(hit, {q(assign)}, 2)) >= 12"),
        (1, "access", "AKIA[A-Z0-9]+", "length(hit) >= 18"),
        (2, "hex", "[0-9a-f]+", "length(hit) >= 16"),
        (3, "entropy", "[A-Za-z0-9+/_=-]{20,}", "entropy"),
    )
    told = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank)"
    parts = " UNION ALL ".join(
        f"SELECT r, {rank} AS rank, '{kind}' AS kind, unnest(regexp_extract_all(text, {q(p)}, 0)) AS hit, "
        f"unnest(list_slice(string_split_regex(text, {q(p)}), 1, -2)) AS gap, "
        f"unnest(range(len(regexp_extract_all(text, {q(p)}, 0)))) AS i FROM d WHERE regexp_matches(text, {q(p)})"
        for rank, kind, p, _ in kinds
    )
    good = " OR ".join(f"(rank = {rank} AND {test})" for rank, _, _, test in kinds[:3])
    windows = (
        "list_max(list_transform(range(length(hit) - 19), lambda i: log2(20) - list_sum(list_transform("
        "map_values(list_histogram(string_split(substr(hit, i + 1, 20), ''))), lambda c: c * log2(c))) / 20))"
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({parts}),
s AS (
    SELECT *, (sum(length(gap) + length(hit)) OVER (PARTITION BY r, rank ORDER BY i))::BIGINT AS b FROM m
), p AS (SELECT r, rank, kind, hit, b - length(hit) AS a, b FROM s),
base AS (SELECT * FROM p WHERE {good}),
tried AS (
    SELECT *, {windows} AS most FROM p WHERE rank = 3
        AND NOT regexp_full_match(hit, '[^0-9]+') AND NOT regexp_full_match(hit, '[0-9+/_=-]+')
        AND NOT regexp_full_match(hit, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}')
        AND NOT regexp_matches(hit, '(?i)example|changeme|placeholder|dummy|xxxx|your')
        AND len(list_distinct(list_transform(range(length(hit)),
            lambda k: (k % 2) || substr(hit, k + 1, 1)))) > 2
), found AS (
    SELECT r, rank, kind, hit, a, b FROM base UNION ALL
    SELECT r, rank, kind, hit, a, b FROM tried
    WHERE most >= CASE WHEN regexp_full_match(hit, '[0-9a-f]+|[0-9A-F]+') THEN 3.0
            WHEN regexp_full_match(hit, '[A-Za-z0-9]+') THEN 3.6 ELSE 3.7 END
        AND NOT EXISTS (SELECT 1 FROM base WHERE base.r = tried.r AND base.a < tried.b AND tried.a < base.b)
)
SELECT any_value(d.doc_id) AS doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'entropy') AS n_entropy,
    sha256(coalesce({told} FILTER (kind <> 'entropy'), '')) AS base_sha256,
    coalesce({told} FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN found ON found.r = d.r GROUP BY d.r
"""


ORACLES["op2_secret_scan"] = _secrets()
ORACLES["op10_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id,
        list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS words
    FROM documents
), s AS (
    SELECT DISTINCT r, unnest(list_transform(
        range(CASE WHEN len(words) = 0 THEN 0 ELSE greatest(len(words) - 4, 1) END),
        lambda i: array_to_string(words[i + 1 : i + 5], ' '))) AS shingle
    FROM d
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (
    SELECT a.r AS a, b.r AS b, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.r <> b.r
    GROUP BY a.r, b.r
), links AS (
    SELECT x.a, x.b, x.n = na.n AND x.n = nb.n AS same
    FROM shared x JOIN n na ON na.r = x.a JOIN n nb ON nb.r = x.b
    WHERE x.n >= 0.8 * (na.n + nb.n - x.n)
), reach AS (
    SELECT r AS a, r AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), classes AS (
    SELECT reach.a AS r, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a
), counts AS (
    SELECT a AS r, count(*) FILTER (same) AS n_copies, count(*) AS n_links FROM links GROUP BY a
)
SELECT d.doc_id, class_id, coalesce(n_copies, 0) AS n_copies, coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN classes USING (r) LEFT JOIN counts USING (r)
"""
ORACLES["op13_warc"] = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
f AS (
    SELECT *, strlen(html) AS n, CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first
    FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
    CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to,
    url AS target_uri, NULL::VARCHAR AS problem
FROM f
"""
ORACLES["op11_periodic_runs"] = f"""
WITH t AS (SELECT {_crc_table()} AS crc),
d AS (
    SELECT row_number() OVER () AS r, doc_id, {_crc_of_number("doc_id")} AS h,
        list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS own
    FROM documents, t
), g AS (SELECT *, h // 10 AS g, len(own) AS n FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (
    SELECT r, i, CASE WHEN i >= a THEN own[1 + a + (i - a) % p] ELSE own[1 + i] END AS word
    FROM (SELECT *, unnest(range(n)) AS i FROM p)
), same AS (
    SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND x.i < y.i
), island AS (
    SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same
), stretch AS (
    SELECT r, q, min(i) AS s, count(*) + q AS l FROM island GROUP BY r, q, k
), runs AS (
    SELECT r, s, l, min(q) AS q FROM stretch WHERE l >= 2 * q AND l >= 12 GROUP BY r, s, l
), longest AS (
    SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY l DESC, s, q) = 1
), told AS (
    SELECT r, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM runs GROUP BY r
), gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS words, count(*) AS n FROM w ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(told.n, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period,
    (1000 * l // q)::BIGINT AS exponent_milli, sha256(coalesce(told.runs, '')) AS runs_sha256,
    sha256(coalesce(words, '')) AS collapsed_sha256, coalesce(kept.n, 0)::BIGINT AS n_kept
FROM d LEFT JOIN longest USING (r) LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""
ORACLES["op12_prefix_trie"] = f"""
WITH t AS (SELECT {_crc_table()} AS crc),
o AS (
    SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS said,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, list(said ORDER BY i) AS own, any_value(h) AS h FROM o JOIN (
        SELECT conv_id, {_crc_of_number("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o), t
    ) USING (conv_id) GROUP BY conv_id
), b AS (
    SELECT c.conv_id, list_concat(coalesce(f.own, [])[1 : c.h], c.own[c.h + 1 :]) AS said
    FROM c LEFT JOIN c f ON f.conv_id = c.conv_id - c.conv_id % 5
), m AS (
    SELECT conv_id, len(said) AS n, unnest(range(len(said) + 1)) AS depth, said FROM b
), p AS (SELECT conv_id, n, depth, said[1 : depth]::VARCHAR AS prefix, said[1 : depth - 1]::VARCHAR AS up,
        CASE WHEN depth > 0 THEN strlen(said[depth].t) ELSE 0 END AS bytes FROM m
), v AS (
    SELECT depth, prefix, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
        string_agg(conv_id, ',' ORDER BY conv_id) FILTER (n = depth) AS ends
    FROM p GROUP BY depth, prefix
), k AS (SELECT depth - 1 AS depth, up AS prefix, count(*) AS n FROM v WHERE depth > 0 GROUP BY ALL),
w AS (SELECT v.*, coalesce(k.n, 0) AS n_children FROM v LEFT JOIN k USING (depth, prefix)),
below AS (
    SELECT p.depth, p.prefix, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.bytes) AS saved
    FROM w JOIN p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY p.depth, p.prefix
)
SELECT w.conv_id, w.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves,
    saved::BIGINT AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN below USING (depth, prefix) LEFT JOIN v a ON a.depth = w.depth - 1 AND a.prefix = w.up AND w.depth > 0
"""
