"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from parlance.llm.alignment import op12_token_alignment
from parlance.llm.langid import op9_language_id
from parlance.llm.lm import op7_lm_scores
from parlance.llm.mixing import op10_source_mixing
from parlance.llm.ngram_join import op1_ngram_jaccard_join
from parlance.llm.packing import op2_best_fit_packing
from parlance.llm.pii import op3_pii
from parlance.llm.quality import op5_quality_rules
from parlance.llm.resampling import op11_importance_resampling
from parlance.llm.simhash import op13_simhash_dedup
from parlance.llm.tokens import op6_token_counts
from parlance.llm.topk import op4_exact_top_k
from parlance.llm.warc import op8_warc

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_pii": op3_pii,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scores": op7_lm_scores,
    "op8_warc": op8_warc,
    "op9_language_id": op9_language_id,
    "op10_source_mixing": op10_source_mixing,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_token_alignment": op12_token_alignment,
    "op13_simhash_dedup": op13_simhash_dedup,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
            FROM documents),
        s AS (
            SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END) AS g
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
        k AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY 1) c ON c.node = d.doc_id""",
    "op4_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
        k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20""",
    "op11_importance_resampling": """
        WITH bits AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS crc FROM range(256) r(b)),
        w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS f FROM documents),
        v AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS f FROM benchmark),
        n AS (SELECT f, sum(s) AS s, sum(t) AS t FROM (SELECT unnest(f) AS f, 1 AS s, 0 AS t FROM w UNION ALL SELECT f, 0, 1 FROM v) GROUP BY 1),
        c AS (SELECT f, s, t, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(hex(f)), 2), lambda i: ('0x' || hex(f)[i:i+1])::BIGINT)), lambda x, b: xor(x >> 8, bits.crc[(xor(x, b) & 255) + 1]))) % 10000 AS bucket FROM n, bits),
        g AS (SELECT bucket, floor(1000 * ln((sum(t) + 1)::DOUBLE * (sum(sum(s)) OVER () + 10000)::DOUBLE / ((sum(s) + 1)::DOUBLE * (sum(sum(t)) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM c GROUP BY 1),
        x AS (SELECT doc_id, len(f) AS n_features, CASE WHEN len(f) = 0 THEN 0 ELSE floor(total / len(f)) END::BIGINT AS weight FROM w LEFT JOIN
            (SELECT doc_id, sum(gain) AS total FROM (SELECT doc_id, unnest(f) AS f FROM w) JOIN c USING (f) JOIN g USING (bucket) GROUP BY 1) USING (doc_id)),
        y AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
        z AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM y)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= able * 10 // 100 THEN place END AS rank FROM z""",
}
