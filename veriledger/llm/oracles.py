"""DuckDB SQL of the operators that SQL can express over whole tables."""

ORACLES = {
    # Distinct five-word shingles of each item, and the documents that hold four fifths of them. Items
    # of fewer words are sought as one run of all their words.
    "op10_minhash_containment": r"""
WITH dw AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bs AS (SELECT DISTINCT item_id, least(len(w), 5) AS width, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM bw WHERE len(w) > 0)),
bn AS (SELECT item_id, width, count(*) AS n FROM bs GROUP BY ALL),
ds AS (SELECT DISTINCT doc_id, w AS whole, width, array_to_string(w[i:i + width - 1], ' ') AS s
       FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM dw, (SELECT DISTINCT width FROM bn) WHERE len(w) >= width)),
hits AS (SELECT doc_id, whole, item_id, n, count(*) AS k FROM ds JOIN bs USING (width, s) JOIN bn USING (item_id, width) GROUP BY ALL)
SELECT doc_id, item_id, max(n) AS n_item_shingles, max(k) AS n_shared, max(k) / max(n) AS containment
FROM hits WHERE k >= ceil(0.8 * n - 1e-9) GROUP BY doc_id, item_id
""",
}
