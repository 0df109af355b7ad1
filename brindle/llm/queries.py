"""The operators' registered queries, and the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.byte_bpe import op5_byte_bpe
from brindle.llm.decontamination import op3_decontamination
from brindle.llm.exact_dedup import op2_exact_dedup
from brindle.llm.hilbert_sharding import op10_hilbert_sharding
from brindle.llm import license_scan
from brindle.llm.jaccard_join import op8_jaccard_join
from brindle.llm.license_scan import op1_license_scan
from brindle.llm.pii import op4_pii
from brindle.llm.quality import op7_quality
from brindle.llm.token_counts import op6_token_counts
from brindle.llm.toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_exact_dedup,
        op3_decontamination,
        op4_pii,
        op5_byte_bpe,
        op6_token_counts,
        op7_quality,
        op8_jaccard_join,
        op9_toxicity,
        op10_hilbert_sharding,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.oracle(),
    "op2_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op3_decontamination": f"""
        WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        lens AS (SELECT DISTINCT least(len(w), 10) AS k FROM iw WHERE len(w) > 0),
        win AS (
            SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
            FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
        pos AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, lens WHERE len(w) >= k),
        occ AS (
            SELECT p.doc_id, p.i, p.k, win.item_id
            FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM pos) p JOIN win ON p.s = win.s AND p.k = win.k),
        hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM occ) GROUP BY doc_id),
        it AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM occ) GROUP BY doc_id)
        SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
}

ORACLES["op8_jaccard_join"] = """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 70 * (any_value(a.n) + any_value(b.n) - count(*))),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT count(*) FROM p WHERE p.x = s.doc_id) AS n_similar,
               (SELECT min(y) FROM r WHERE r.x = s.doc_id) AS component_id
        FROM s"""
