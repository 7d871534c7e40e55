"""The queries of this subpackage, by name."""

from __future__ import annotations

from .byte_bpe import op8_byte_bpe
from .chat_format import op2_chat_format
from .embedding_dedup import op9_embedding_dedup
from .fingerprints import op7_fingerprints
from .jaccard_join import op4_jaccard_join
from .licenses import op10_license_scan
from .packing import op5_best_fit_packing
from .substring_dedup import op3_substring_dedup
from .token_store import op6_token_store
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_chat_format": op2_chat_format,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_token_store": op6_token_store,
    "op7_fingerprints": op7_fingerprints,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_license_scan": op10_license_scan,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: SQL for those that SQL can express; tests/llm holds all of them against brute force.
ORACLE: dict[str, str] = {
    "op2_chat_format": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        m AS (SELECT *, '### ' || regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g') || ': ' || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || '</turn>' || chr(10) AS formatted FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length(formatted))::BIGINT AS formatted_chars FROM m GROUP BY conv_id""",
    "op4_jaccard_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
        e AS (SELECT doc_id, unnest(sh) AS t FROM s), n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 90 * (x.n + y.n - i)),
        links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT links.b, r.root FROM r JOIN links ON links.a = r.doc_id AND r.root < links.b)
        SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.root) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id""",
}
