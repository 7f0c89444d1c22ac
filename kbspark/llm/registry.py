"""The registered queries of the training-data operators."""

from __future__ import annotations

from kbspark.llm import ann, bpe, decontam, filter_audit, fim, html_extract, lines, minhash, mixing, pii, token_counts, token_output, toxicity


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_ann": ann.op2_ann,
        "op3_decontamination": decontam.op3_decontamination,
        "op4_minhash": minhash.op4_minhash,
        "op5_html": html_extract.op5_html,
        "op6_bpe": bpe.op6_bpe,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_token_output": token_output.op9_token_output,
        "op10_line_templates": lines.op10_line_templates,
        "op11_mixing": mixing.op11_mixing,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_fim": fim.op13_fim,
    }


#: op4 by all pairs of documents that share a shingle, and a recursive walk over the links.
NEAR_DUPLICATES = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS doc, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc),
k AS (SELECT doc, min(m) AS component_id FROM r GROUP BY doc)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN k ON k.doc = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash": NEAR_DUPLICATES, "op11_mixing": mixing.SQL, "op12_filter_audit": filter_audit.SQL, "op13_fim": fim.SQL}
