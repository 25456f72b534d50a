"""The queries that SQL can express, for DuckDB."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), written AS (
  SELECT *,
    CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'system' THEN 6 WHEN 'tool' THEN 4
      ELSE 1 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c')) END AS label_chars,
    CASE WHEN contains(text, '###') OR contains(text, '</turn>') OR contains(text, '\b') OR contains(text, '\h') OR contains(text, '\t')
      THEN replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') ELSE text END AS body
  FROM rows
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + label_chars + 2 + length(body) + 7 + 1)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""

OP4 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS run
  FROM b, unnest(range(1, greatest(len(words) - 8, 2))) AS t(i) WHERE len(words) > 0
), dw AS (
  SELECT rid, i, s.size, array_to_string(words[i:i + s.size - 1], ' ') AS run
  FROM d, (SELECT DISTINCT size FROM bw) s, unnest(range(1, len(words) - s.size + 2)) AS t(i)
), hits AS (
  SELECT rid, i, dw.size, item_id FROM dw JOIN bw ON dw.run = bw.run AND dw.size = bw.size
), words AS (
  SELECT rid, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, size)) AS t(k) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, coalesce(item_id::VARCHAR, '') AS id FROM hits) GROUP BY rid
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), runs AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS run FROM w, unnest(range(1, len(words) - 3)) AS t(i)
), again AS (
  SELECT rid, i FROM runs QUALIFY count(*) OVER (PARTITION BY rid, run) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, unnest(range(0, 5)) AS t(k) GROUP BY rid
), m AS (
  SELECT rid, doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(array_to_string(words, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * word_chars
      OR 100 * n_dup_lines > 30 * n_lines AS failed
  FROM m
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM judged WHERE source IS NOT NULL GROUP BY source
), moments AS (
  SELECT least(greatest(avg(f / n), 0.001), 0.999) AS mean,
    greatest(coalesce(var_pop(f / n), 0) - avg((f / n) * (1 - f / n) / n), 0.000001) AS between_hosts
  FROM hosts
), prior AS (
  SELECT mean, least(greatest(mean * (1 - mean) / between_hosts - 1, 1), 1000) AS strength FROM moments
), bad AS (
  SELECT source FROM hosts, prior WHERE (f + mean * strength) / (n + strength) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(source NOT IN (SELECT source FROM bad), true) AS kept
FROM judged
"""

FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_HALVE = """SELECT {key}, level + 1, list_transform(range(0, (len(nodes) + 1) // 2),
    lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM {tree} WHERE len(nodes) > 1"""

OP11 = f"""
WITH RECURSIVE bits AS (  -- the table of CRC-32, from its polynomial
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {_leaf("n_chars")} AS leaf,
    {_leaf("(n_chars + 1)")} AS changed,
    list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)) AS bytes
  FROM documents
), ranked AS (
  SELECT rid, doc_id, g, leaf, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
    CASE WHEN doc_id IS NOT NULL AND
      xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 THEN changed ELSE leaf END AS begin
  FROM d, crc
), tree AS (
  SELECT g, 0 AS level, list(leaf ORDER BY rank) AS nodes FROM ranked GROUP BY g UNION ALL {_HALVE.format(key="g", tree="tree")}
), top AS (
  SELECT 0 AS one, 0 AS level, list(nodes[1] ORDER BY g) AS nodes FROM tree WHERE len(nodes) = 1
  UNION ALL {_HALVE.format(key="one", tree="top")}
), steps AS (
  SELECT rid, level, (rank >> level) & 1 AS digit, coalesce(nodes[xor(rank >> level, 1) + 1], '') AS other
  FROM ranked JOIN tree USING (g) WHERE len(nodes) > 1
  UNION ALL SELECT rid, 1000 + level, (g >> level) & 1, coalesce(nodes[xor(g >> level, 1) + 1], '')
  FROM ranked, top WHERE len(nodes) > 1
), paths AS (
  SELECT rid, string_agg(other, '' ORDER BY level) AS proof, list(digit::VARCHAR || other ORDER BY level) AS way FROM steps GROUP BY rid
), folded AS (
  SELECT r.*, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(r.begin, coalesce(way, []::VARCHAR[])),
      lambda acc, s: CASE WHEN s[1] = '0' THEN sha256(acc || s[2:]) ELSE sha256(s[2:] || acc) END) AS folded_root
  FROM ranked r LEFT JOIN paths USING (rid)
)
SELECT f.doc_id, f.leaf, tree.nodes[1] AS subroot, top.nodes[1] AS root, proof_sha256, folded_root, folded_root = top.nodes[1] AS verified
FROM folded f JOIN tree ON tree.g = f.g AND len(tree.nodes) = 1 JOIN top ON len(top.nodes) = 1
"""

OP13 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e,
    coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS sound
  FROM embeddings
), s AS MATERIALIZED (SELECT rid, e, len(e) AS size FROM v WHERE sound),
links AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b FROM s a JOIN s b ON a.size = b.size AND a.rid <> b.rid WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT rid, rid AS at FROM v UNION SELECT reach.rid, links.b FROM reach JOIN links ON reach.at = links.a
), least AS (
  SELECT reach.rid, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.at GROUP BY reach.rid
), degree AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v LEFT JOIN degree USING (rid) JOIN least USING (rid)
"""

ORACLE_SQL = {
    "op1_chat_format": OP1,
    "op4_winnowing": OP4,
    "op10_host_rules": OP10,
    "op11_merkle_manifest": OP11,
    "op13_pca_tiles": OP13,
}
