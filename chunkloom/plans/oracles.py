"""SQL that DuckDB runs on the same tables, for each registered query that SQL can express."""

from __future__ import annotations

#: Sentences as lists; both dialects' patterns agree on these tables, whose only white space is ASCII.
_STRIP = "regexp_replace(x, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"


def _sentences(pattern: str, text: str = "text") -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '{pattern}'), lambda x: {_STRIP}), lambda x: length(x) > 0)"


CJK, LATIN = "[^。！？…\\n]+[。！？…\\n]?", "[^.!?\\n]+[.!?]*"
WORD, WORD_CJK = "\\S+", "[぀-ヿ㐀-䶿一-鿿]|[^\\s぀-ヿ㐀-䶿一-鿿]+"
#: What turns a text into one without spaces; the last character of the first has no counterpart and goes.
CJK_FROM, CJK_TO = "aeiou.!? ", "的一是在有。！？"


def _counted(cjk: bool = False) -> str:
    """Common table expressions s(doc_id, ss) and c(doc_id, ss, cs): sentences and their token counts."""
    sents = _sentences(CJK, f"translate(text, '{CJK_FROM}', '{CJK_TO}')") if cjk else _sentences(LATIN)
    return f"s AS (SELECT doc_id, {sents} AS ss FROM documents), c AS (SELECT doc_id, ss, list_transform(ss, lambda x: len(regexp_extract_all(x, '{WORD_CJK if cjk else WORD}'))) AS cs FROM s)"


_SENTS = f"s AS (SELECT doc_id, {_sentences(LATIN)} AS ss FROM documents)"
_COUNTED = _counted()


def _rows(pattern: str) -> str:
    return f"SELECT doc_id, CAST(i AS BIGINT) AS pos, ss[i + 1] AS sentence FROM (SELECT doc_id, ss, unnest(range(len(ss))) AS i FROM (SELECT doc_id, {_sentences(pattern)} AS ss FROM documents))"


def _tokens(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents),
    i AS (SELECT doc_id, w, unnest(range(greatest(CAST(ceil((len(w) - {overlap}) / {step}.0) AS BIGINT) - 1, 0) + 1)) AS i FROM t WHERE len(w) > 0)
    SELECT doc_id, CAST(i AS BIGINT) AS chunk_idx, CAST(len(w[i * {step} + 1:i * {step} + {size}]) AS BIGINT) AS n_tokens, array_to_string(w[i * {step} + 1:i * {step} + {size}], ' ') AS text FROM i"""


def _pack(source: str, keys: str, size: int, overlap: int) -> str:
    """Recursive common table expressions walk(keys, n, p, i, s, es, ee): a step a sentence; es to ee is the run it closed."""
    return f"""walk AS (
      SELECT {keys}, n, p, 0 AS i, 0 AS s, NULL::INT AS es, NULL::INT AS ee FROM {source} WHERE n > 0
      UNION ALL
      SELECT {keys}, n, p, i + 1,
        CASE WHEN i < n AND i > s AND p[i + 2] - p[s + 1] > {size} THEN CAST(list_min(list_filter(range(s + 1, i + 1), lambda j: j = i OR (p[i + 1] - p[j + 1] <= {overlap} AND p[i + 2] - p[j + 1] <= {size}))) AS INT) ELSE s END,
        CASE WHEN i = n OR (i > s AND p[i + 2] - p[s + 1] > {size}) THEN s END,
        CASE WHEN i = n OR (i > s AND p[i + 2] - p[s + 1] > {size}) THEN i END
      FROM walk WHERE i <= n)"""


_PREFIX = "list_transform(range(len(cs) + 1), lambda k: coalesce(list_sum(cs[1:k]), 0))"


def _packed(size: int, overlap: int) -> str:
    return f"""WITH RECURSIVE {_COUNTED}, q AS (SELECT doc_id, CAST(len(cs) AS INT) AS n, {_PREFIX} AS p FROM c), {_pack('q', 'doc_id', size, overlap)}
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ee) - 1 AS chunk_idx, CAST(p[ee + 1] - p[es + 1] AS BIGINT) AS n_tokens, array_to_string(ss[es + 1:ee], ' ') AS text
    FROM walk JOIN c USING (doc_id) WHERE ee IS NOT NULL"""


_WINDOW = f"""WITH {_SENTS}, i AS (SELECT doc_id, ss, unnest(range(len(ss))) AS i FROM s)
SELECT doc_id, CAST(i AS BIGINT) AS chunk_idx, CAST(len(regexp_extract_all(ss[i + 1], '\\S+')) AS BIGINT) AS n_tokens, ss[i + 1] AS text, ss[i + 1] AS original_text, array_to_string(ss[greatest(i - 3, 0) + 1:i + 4], ' ') AS "window" FROM i"""


def _vector(text: str) -> str:
    return f"list_transform(range(97, 123), lambda c: CAST(length(lower({text})) - length(replace(lower({text}), chr(CAST(c AS INT)), '')) AS DOUBLE))"


def _vectors(buffer: int, cjk: bool = False) -> str:
    return f"""{_counted(cjk)}, g AS (SELECT doc_id, i, array_to_string(ss[greatest(i - {buffer}, 0) + 1:i + {buffer + 1}], '{'' if cjk else ' '}') AS t FROM (SELECT doc_id, ss, unnest(range(len(ss))) AS i FROM c)),
    v AS (SELECT doc_id, i, {_vector('t')} AS v FROM g),
    w AS (SELECT doc_id, i, v, lead(v) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM v)"""


_COSINE = "list_inner_product({0}, {1}) / nullif(sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1})), 0)"


def _breaks(percentile: float, cjk: bool = False) -> str:
    return f"""{_vectors(1, cjk)}, d AS (SELECT doc_id, i, round(1.0 - {_COSINE.format('v', 'u')}, 9) AS d FROM w WHERE u IS NOT NULL),
    th AS (SELECT doc_id, round(quantile_cont(d, {percentile / 100}), 9) AS th FROM d GROUP BY 1),
    b AS (SELECT doc_id, i FROM d JOIN th USING (doc_id) WHERE d > th),
    e AS (SELECT doc_id, 0 AS k FROM c WHERE len(ss) > 0 UNION ALL SELECT doc_id, i + 1 FROM b UNION ALL SELECT doc_id, len(ss) FROM c WHERE len(ss) > 0),
    r AS (SELECT doc_id, CAST(k AS INT) AS a, CAST(lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS INT) AS z FROM e),
    sem AS (SELECT doc_id, a, z, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS parent_idx FROM r WHERE z > a)"""


def _semantic(percentile: float) -> str:
    return f"WITH {_breaks(percentile)} SELECT doc_id, parent_idx AS chunk_idx, CAST(list_sum(cs[a + 1:z]) AS BIGINT) AS n_tokens, array_to_string(ss[a + 1:z], ' ') AS text FROM sem JOIN c USING (doc_id)"


def _hybrid(cjk: bool = False) -> str:
    return f"""WITH RECURSIVE {_breaks(95, cjk)},
x AS (SELECT doc_id, parent_idx, a, cs[a + 1:z] AS cs, ss[a + 1:z] AS ss, list_sum(cs[a + 1:z]) AS total FROM sem JOIN c USING (doc_id)),
q AS (SELECT doc_id, parent_idx, CAST(len(cs) AS INT) AS n, {_PREFIX} AS p FROM x WHERE total > 300),
{_pack('q', 'doc_id, parent_idx', 256, 50)},
parts AS (
  SELECT doc_id, parent_idx, 0 AS es, CAST(len(cs) AS INT) AS ee FROM x WHERE total <= 300
  UNION ALL SELECT doc_id, parent_idx, es, ee FROM walk WHERE ee IS NOT NULL),
h AS (SELECT doc_id, parent_idx, row_number() OVER (PARTITION BY doc_id, parent_idx ORDER BY ee) - 1 AS sub_idx, row_number() OVER (PARTITION BY doc_id ORDER BY parent_idx, ee) - 1 AS chunk_idx,
  CAST(list_sum(cs[es + 1:ee]) AS BIGINT) AS n_tokens, array_to_string(ss[es + 1:ee], '{'' if cjk else ' '}') AS text FROM parts JOIN x USING (doc_id, parent_idx))"""


_HYBRID_CTES = _hybrid()

_PAIRS = "SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
_VECTORS = f"SELECT vec_id, round(list_inner_product(a, b), 6) AS dot, round(sqrt(list_inner_product(a, a)), 6) AS norm, round({_COSINE.format('a', 'b')}, 6) AS cosine FROM ({_PAIRS})"

_EXTENSION = "lower(coalesce(regexp_extract(path, '[^/.](\\.[^./]+)$', 1), ''))"
_MIME = "CASE {0} WHEN '.pdf' THEN 'application/pdf' WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN '.doc' THEN 'application/msword' WHEN '.txt' THEN 'text/plain' END"
_LISTING = "SELECT 'store/' || source || '/' || CAST(doc_id AS VARCHAR) || ['.pdf', '.PDF', '.docx', '.doc', '.txt', ''][doc_id % 6 + 1] AS path, n_chars * 1024 AS length, text, doc_id, source FROM documents"
_FILES = f"l AS (SELECT *, {_EXTENSION} AS extension FROM ({_LISTING}))"

ORACLES: dict[str, str] = {
    "g1_sentences_cjk": _rows(CJK),
    "g1_sentences_latin": _rows(LATIN),
    "m5_token_counts": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n_tokens, CAST(length(text) AS BIGINT) AS n_letters, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length({_STRIP.replace('(x,', '(text,')}) AS BIGINT) AS n_stripped FROM documents",
    "g2_token_chunks_500_100": _tokens(500, 100),
    "g2b_token_chunks_30_0": _tokens(30, 0),
    "g2b_token_chunks_30_10": _tokens(30, 10),
    "g3_sentence_pack_512_100": _packed(512, 100),
    "g4_sentence_pack_500_65": _packed(500, 65),
    "g5_sentence_pack_256_50": _packed(256, 50),
    "g6_sentence_window_3": _WINDOW,
    "t4_window_replacement": f"""SELECT doc_id, chunk_idx, CASE WHEN chunk_idx % 2 = 0 THEN "window" ELSE text END AS shown, CASE WHEN chunk_idx % 2 = 0 THEN "window" ELSE 'N/A' END AS window_or_default FROM ({_WINDOW})""",
    "g7_semantic_p95": _semantic(95),
    "g7_semantic_p5": _semantic(5),
    "g8_hybrid": f"{_HYBRID_CTES} SELECT doc_id, chunk_idx, parent_idx, sub_idx, n_tokens, text FROM h",
    "g8_hybrid_cjk": f"{_hybrid(True)} SELECT doc_id, chunk_idx, parent_idx, sub_idx, n_tokens, text FROM h",
    "g8_hybrid_sizes": f"{_HYBRID_CTES}, pp AS (SELECT doc_id, parent_idx, count(*) AS parts, max(n_tokens) AS largest FROM h GROUP BY ALL) SELECT parts > 1 AS resplit, count(*) AS parents, CAST(sum(parts) AS BIGINT) AS chunks, max(largest) AS largest FROM pp GROUP BY 1",
    "g10_overlap_preview": f"WITH p AS ({_packed(500, 65)}), o AS (SELECT doc_id, max(CASE WHEN chunk_idx = 0 THEN text END) AS a, max(CASE WHEN chunk_idx = 1 THEN text END) AS b FROM p GROUP BY 1) SELECT doc_id, {_STRIP.replace('(x,', '(right(a, 65),')} AS end_of_first, {_STRIP.replace('(x,', '(left(b, 65),')} AS start_of_second FROM o WHERE b IS NOT NULL",
    "k9_adjacent_similarity": f"WITH {_vectors(0)}, d AS (SELECT doc_id, i, round({_COSINE.format('v', 'u')}, 9) AS similarity FROM w WHERE u IS NOT NULL), th AS (SELECT doc_id, round(quantile_cont(similarity, 0.95), 6) AS threshold FROM d GROUP BY 1) SELECT doc_id, threshold, CAST(i AS BIGINT) AS pos, similarity FROM d JOIN th USING (doc_id)",
    "a1_page_counts": f"WITH t AS ({_tokens(500, 100)}) SELECT d.source, pages_processed, chunks_processed FROM (SELECT source, count(*) AS pages_processed FROM documents GROUP BY 1) d JOIN (SELECT source, count(*) AS chunks_processed FROM t JOIN documents USING (doc_id) GROUP BY 1) c USING (source)",
    "a5_conversation_text": "SELECT conv_id, count(*) AS n, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1",
    "s_conversation_children": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS child_idx, text AS page_content, role FROM conversations",
    "s_document_pages": "SELECT sha256(source || '|' || CAST(doc_id AS VARCHAR)) AS id_, text AS page_content, source, CAST(doc_id AS INT) AS page, 'dify' AS provider FROM documents",
    "p9_library_documents": """SELECT text, '{"source":"' || source || '","page":' || CAST(doc_id AS VARCHAR) || '}' AS metadata FROM documents""",
    "m1_vector_functions": _VECTORS,
    "a4_similarity_percentile": f"SELECT round(quantile_cont(cosine, 0.05), 6) AS p5, round(quantile_cont(cosine, 0.5), 6) AS p50, round(quantile_cont(cosine, 0.95), 6) AS p95 FROM ({_VECTORS})",
    "t1_vector_top_k": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, round({_COSINE.format('q.v', 'r.v')}, 6) AS score FROM e q, e r WHERE q.vec_id % 20 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank, row_id, score FROM x QUALIFY rank <= 4""",
    "t2_retrieval": f"""{_HYBRID_CTES}, cv AS (SELECT doc_id, chunk_idx, text, {_vector('text')} AS v FROM h), qv AS (SELECT item_id, {_vector('text')} AS v FROM benchmark),
    y AS (SELECT item_id, doc_id, chunk_idx, cv.text, round({_COSINE.format('qv.v', 'cv.v')}, 6) AS score FROM qv, cv)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk_idx) AS rank, doc_id, chunk_idx, score, text FROM y WHERE score IS NOT NULL QUALIFY rank <= 4""",
    "p4_url_gate": "SELECT page_id, regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+') AS valid, starts_with(url, 'http://') OR starts_with(url, 'https://') AS web, regexp_extract(url, '://([^/?#]+)', 1) AS host, lower(regexp_extract(regexp_extract(url, '^[^?#]*'), '[^/.](\\.[^./]+)$', 1)) AS extension FROM pages",
    "p1_upload_gates": f"WITH {_FILES} SELECT path, length, extension, {_MIME.format('extension')} AS mime_type, CASE WHEN extension NOT IN ('.pdf', '.docx', '.doc') THEN 'unsupported type ' || extension WHEN length > 10485760 THEN 'too large' END AS error FROM l",
    "s_upload_records": f"""WITH {_FILES}, n AS (SELECT *, sha256(text) AS digest, regexp_extract(path, '[^/]*$') AS name FROM l)
    SELECT sha256(source || '|' || digest || '|' || name) AS id, source AS tenant_id, 'local' AS storage_type, 'upload_files/' || source || '/' || digest || extension AS key, name, length AS size, ltrim(extension, '.') AS extension,
      {_MIME.format('extension')} AS mime_type, 'account' AS created_by_role, 'system' AS created_by, false AS used, digest AS hash, '' AS source_url FROM n""",
    "k1_landed_uploads": f"""WITH {_FILES} SELECT DISTINCT 'upload_files/' || source || '/' || sha256(text) || extension AS key, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS hash FROM l""",
    "s15_storage_scan": f"WITH l AS ({_LISTING}) SELECT DISTINCT path, false AS is_dir FROM l UNION ALL SELECT DISTINCT 'store/' || source || '/', true FROM l",
    "k5_storage_exists_delete": f'WITH l AS ({_LISTING}) SELECT path, doc_id % 3 <> 0 AS "exists" FROM l',
    "c1_cached_pages": "SELECT doc_id AS key, 0 AS page, CASE WHEN doc_id % 2 = 0 THEN text ELSE text || '!' END AS text FROM documents",
    "r1_table_markdown": "SELECT r_name, '| key | name | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || CAST(n_nationkey AS VARCHAR) || ' | ' || n_name || ' |  |', chr(10) ORDER BY n_nationkey) AS markdown, CAST(2 AS BIGINT) AS columns FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "r3_cell_text": f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP}), lambda x: length(x) > 0) AS ps FROM documents)
    SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(list_zip(ps, range(len(ps))), lambda y: list_position(ps, y[1]) = y[2] + 1), lambda y: y[1]), ' '), '') AS cell FROM p""",
    "w3_hyperlinks": """WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE 't' || CAST(turn AS VARCHAR) END AS t, CASE WHEN turn % 3 = 0 THEN 'https://h/' || CAST(turn AS VARCHAR) END AS u FROM conversations),
    x AS (SELECT a.conv_id, a.turn, a.t, (SELECT max(b.turn) FROM r b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.u IS NOT NULL) AS last_url, (SELECT max(b.turn) FROM r b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.t <> '') AS last_text FROM r a)
    SELECT conv_id, turn, CASE WHEN t <> '' AND last_url IS NOT NULL AND last_url >= coalesce(last_text, -1) THEN '[' || t || '](https://h/' || CAST(last_url AS VARCHAR) || ')' ELSE t END AS rendered FROM x""",
    "j1_image_links": "SELECT a.source, a.doc_id, 'rId' || CAST(a.doc_id % 7 AS VARCHAR) AS rel_id, CASE WHEN a.doc_id % 7 < 4 THEN 'img/' || a.source || '/' || CAST(a.doc_id % 7 AS VARCHAR) END AS link FROM documents a",
    "f4_rendering": "SELECT page_id, '[' || CAST(page_id AS VARCHAR) || '](' || url || ')' AS link, '![image](http://files/files/' || CAST(page_id AS VARCHAR) || '/file-preview)' AS image, 'page' || repeat(chr(10) || '[image]', CAST(page_id % 3 AS INT)) AS marked, '  a' || chr(10) || '  b' AS indented, CASE WHEN page_id % 3 = 0 THEN '.png' END AS extension FROM pages",
    "f7_image_magic": "SELECT page_id, ['jpg', 'png', 'jp2', 'gif', 'bmp', 'tiff', 'tiff', 'tiff', 'tiff', NULL][page_id % 10 + 1] AS format FROM pages",
    "f3_page_urls": "SELECT page_id, CAST(i AS BIGINT) AS pos, [url, 'https://a.com/b', url || '.'][i + 1] AS found FROM (SELECT page_id, url, unnest(range(3)) AS i FROM pages)",
    "s16_byte_pieces": "SELECT doc_id, CAST(ceil(strlen(text) / 4096.0) AS BIGINT) AS pieces, CAST(CASE WHEN strlen(text) > 0 THEN least(strlen(text), 4096) END AS BIGINT) AS first, CAST(CASE WHEN strlen(text) > 0 THEN (strlen(text) - 1) % 4096 + 1 END AS BIGINT) AS last FROM documents",
    "s_enum_checks": "SELECT conv_id, turn, role IN ('user', 'assistant') AS known, turn <= 1 AS equals_null FROM conversations",
    "s11_docx_round_trip": f"SELECT doc_id, CAST(0 AS BIGINT) AS page, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length({_STRIP}) > 0 THEN {_STRIP} ELSE chr(10) END), chr(10)) AS text, CAST(NULL AS VARCHAR) AS error FROM documents",
    "s8_pdf_round_trip": "SELECT doc_id, CAST(0 AS BIGINT) AS page, text, CAST(NULL AS VARCHAR) AS error FROM documents",
}
