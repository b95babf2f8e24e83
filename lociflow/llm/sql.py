"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from lociflow.llm import licenses, urls
from lociflow.llm.mixing import MOST_EPOCHS, WEIGHTS

_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"

_MIX = f"""
    d AS (SELECT *, {_SIZE} AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM {{docs}}),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, ([{", ".join(f"{x}.0::DOUBLE" for x in WEIGHTS)}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS w,
                 {MOST_EPOCHS}::DOUBLE * source_size AS cap FROM s),
    r AS (SELECT *, cap / w AS ratio,
                 (sum(source_size) OVER ())::BIGINT::DOUBLE - coalesce(sum(cap) OVER b, 0::DOUBLE) AS rest,
                 sum(w) OVER () - coalesce(sum(w) OVER b, 0::DOUBLE) AS open
          FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT min_by(rest / open, (ratio, source)) AS level FROM r WHERE NOT rest >= ratio * open),
    t AS (SELECT r.source, source_size, CASE WHEN rest >= ratio * open OR level IS NULL THEN cap ELSE r.w * level END AS target FROM r, l),
    p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs,
                 floor(target)::BIGINT AS budget,
                 coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    mixed AS (SELECT *, (epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)))::BIGINT AS taken FROM p)
"""

OP3 = "WITH" + _MIX.replace("{docs}", "documents") + "SELECT doc_id, size, source_size, target, taken FROM mixed"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_DEDUP = f"""
    w AS (SELECT doc_id, {_WORDS} AS ws FROM {{docs}}),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                 ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
    l2 AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM {{docs}} UNION SELECT r.x, l2.y FROM reach r JOIN l2 ON r.y = l2.x),
    grouped AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
"""

OP5 = "WITH RECURSIVE" + _DEDUP.replace("{docs}", "documents") + """
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN grouped USING (doc_id) LEFT JOIN n USING (doc_id)"""


OP8 = """WITH RECURSIVE v AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS m
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.m > 0 AND b.m > 0 AND len(a.v) = len(b.v)
          WHERE list_inner_product(a.v, b.v) / (a.m * b.m) >= 0.98),
    reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
    c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
    n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
    SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
    FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""


def _op2() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
    words = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda w: w <> '')"
    shingles = "unnest(CASE WHEN len(w) < 5 THEN [] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)"
    return f"""WITH t0 AS (SELECT license_id, {words.format('body')} AS w FROM (VALUES {values}) AS v(license_id, body)),
    t AS (SELECT DISTINCT license_id, {shingles} AS s FROM t0),
    n AS (SELECT license_id, count(*) AS n FROM t GROUP BY 1),
    d AS (SELECT doc_id, {words.format('text')} AS w FROM documents),
    h AS (SELECT DISTINCT doc_id, {shingles} AS s FROM d),
    m AS (SELECT doc_id, license_id, count(*) AS m FROM h JOIN t USING (s) GROUP BY 1, 2)
    SELECT doc_id, license_id, n AS n_shingles, m AS n_matched, m / n AS containment FROM m JOIN n USING (license_id) WHERE 100 * m >= {licenses.PERCENT} * n"""


def _terms(terms: list[str]) -> str:
    edge = r"[^\p{L}\p{N}]"
    return " + ".join(f"(regexp_matches(lower(coalesce(url, '')), '(^|{edge}){t}($|{edge})'))::INT * {n}" for t, n in terms) or "0"


def _op10() -> str:
    rank = sorted(range(len(urls.RULES)), key=lambda k: -len(urls.RULES[k][1]) - len(urls.RULES[k][2]))
    fits = {k: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for k, (_, h, p) in enumerate(urls.RULES)}
    rule = "CASE " + " ".join(f"WHEN {fits[k]} THEN '{urls.RULES[k][1] + urls.RULES[k][2]}'" for k in rank) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits[k]} THEN '{urls.RULES[k][0]}'" for k in rank) + f" WHEN n_strict >= 1 OR soft_weight >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END"
    rest = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    return f"""WITH a AS (SELECT page_id, url, {rest} AS rest FROM pages),
    b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                 ({_terms([(t, 1) for t in urls.STRICT])})::INT AS n_strict, ({_terms(list(urls.SOFT.items()))})::INT AS soft_weight FROM a)
    SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, n_strict, soft_weight FROM b"""


OP12 = r"""WITH d AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    m AS (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT
                 + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS failed,
                 coalesce(quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
          FROM d LEFT JOIN labels l USING (doc_id)),
    n AS (SELECT part, failed, good, toxic, count(*) AS n FROM m GROUP BY ALL),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
    o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
          FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
    s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)),
    r AS (SELECT part, filter_order, step, bit,
                 coalesce(sum(n) FILTER (failed & (before | bit) = 0), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER (failed & bit > 0 AND failed & before = 0), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (failed & bit > 0 AND failed & before > 0), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (failed = bit), 0)::BIGINT AS unique_fails,
                 coalesce(sum(n) FILTER (failed & bit > 0 AND failed & before = 0 AND good), 0)::BIGINT AS good_lost,
                 coalesce(sum(n) FILTER (failed & bit > 0 AND failed & before = 0 AND toxic), 0)::BIGINT AS toxic_lost
          FROM n, s GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""


def _op13() -> str:
    near = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = [
        """k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "p AS (SELECT vec_id, label, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] AS x FROM k, range(16) r(part))",
        """b0 AS (SELECT part, e, x AS c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 64) USING (vec_id))""",
    ]
    for r in range(3):
        ctes.append(f"a{r} AS (SELECT vec_id, any_value(label) AS label, part, any_value(x) AS x, min((({near}), e)) AS d FROM p JOIN b{r} USING (part) GROUP BY vec_id, part)")
        if r < 2:
            ctes.append(f"s{r} AS (SELECT part, e, k, floor(sum(y)::DOUBLE / count(*))::BIGINT AS y FROM (SELECT part, d[2] AS e, unnest(x) AS y, generate_subscripts(x, 1) AS k FROM a{r}) GROUP BY ALL)")
            ctes.append(f"m{r} AS (SELECT part, e, list(y ORDER BY k) AS c FROM s{r} GROUP BY ALL)")
            ctes.append(f"b{r + 1} AS (SELECT part, e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (part, e))")
    return "WITH " + ",\n    ".join(ctes) + """
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256
    FROM (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', d[2]), '' ORDER BY part) AS code, sum(d[1])::BIGINT AS error FROM a2 GROUP BY vec_id)"""


ORACLE_SQL = {"op12_filter_audit": OP12, "op13_vector_codes": _op13(), "op2_license_scan": _op2(), "op3_mixing": OP3, "op5_near_duplicates": OP5, "op8_embedding_dedup": OP8, "op10_url_filter": _op10()}
