"""Registered queries of the subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from tallywright.llm import bpe, cotrain, decontam, hmm_lm, langid, multi_index, secret_scan, simhash, suffix_dedup, warc

QUERIES = {
    "op1_decontamination": decontam.op1,
    "op2_secret_scan": secret_scan.op2,
    "op3_simhash_dedup": simhash.op3,
    "op4_hmm_lm": hmm_lm.op4,
    "op5_suffix_dedup": suffix_dedup.op5,
    "op6_byte_bpe": bpe.op6,
    "op7_multi_index": multi_index.op7,
    "op8_warc": warc.op8,
    "op9_language_id": langid.op9,
    "op10_quality": cotrain.op10,
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _spans(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """Spans of a rule: the lengths of what stands between matches and of the matches add up to places."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, spot AS start, spot + length(m) AS stop FROM (
            SELECT doc_id, ms[i] AS m, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS spot
            FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
                SELECT doc_id, regexp_extract_all(t, '{quoted}') AS ms, string_split_regex(t, '{quoted}') AS ps FROM t)))
        WHERE length(regexp_extract(m, '{quoted}', {group})) >= {least}"""


_ASSIGN = """(?i:password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS, _HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"

ORACLES: dict[str, str] = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
        ), grams AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
        ), found AS (SELECT doc_id, item_id, win.n, i FROM grams JOIN win USING (n, g)),
        hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
        items AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op2_secret_scan": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        s AS ({_spans("assign", 0, _ASSIGN, 1, 6)} UNION ALL {_spans("access", 1, _ACCESS, 0, 20)} UNION ALL {_spans("hex", 2, _HEX, 0, 24)}),
        g AS (
            SELECT doc_id, count(*) FILTER (WHERE place = 0) AS n_assign, count(*) FILTER (WHERE place = 1) AS n_access, count(*) FILTER (WHERE place = 2) AS n_hex,
                   string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, place) AS listed FROM s GROUP BY 1
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(listed, '')) AS base_sha256, coalesce(listed, '') AS spans
        FROM t LEFT JOIN g USING (doc_id)
    """,
    "op7_multi_index": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
        ), r AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
        ), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
    """,
    "op8_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), d AS (
            SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest FROM p
        ), f AS (
            SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1
        )
        SELECT page_id, payload_bytes, d.payload_digest,
               CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
        FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest
    """,
}
