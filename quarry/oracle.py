"""Independent DuckDB SQL for every registered query (correctness oracle).

The base tables (documents, conversations, ...) are views in the checking
database; the Q&A model tables are re-derived here as CTEs with the same
definitions as ``quarry.sources.qa_model``.  Regexes are written in the
common subset of Java regex and RE2 (no look-around, no back-references).
"""

from __future__ import annotations

from .resources import stop_words


def _lit_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


STOP_SQL = _lit_list(stop_words())
# Two or more characters that are no white space; written here on its own.
TOKEN_RE = "[^\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \\x{85}\\pZ]{2,}"
WORD_RE = "[^\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \\x{85}\\pZ]+"


def space_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD_RE}')"



# lambda name: (sql body, dependencies)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "questions": ("""
        SELECT doc_id AS post_id,
               split_part(text, chr(10), 1) AS title,
               text AS body,
               '<' || lang || '><' || source || '>' AS tags,
               CAST((n_chars % 41) - 3 AS INTEGER) AS score,
               CAST(doc_id % 4 AS INTEGER) AS answer_count,
               CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id * 100 + 1 END AS accepted_answer_id
        FROM documents""", ()),
    "answers": ("""
        SELECT conv_id * 100 + turn AS answer_id, conv_id AS parent_id,
               '<p>' || text || '</p>'
               || CASE WHEN (conv_id + turn) % 3 <> 0 THEN
                    '<pre><code>import java.util.Map;' || chr(10) || 'Map m = new HashMap();' || chr(10)
                    || 'm.put("k' || CAST(conv_id * 100 + turn AS VARCHAR) || '", ' || CAST(turn AS VARCHAR)
                    || ');' || chr(10) || 'System.out.println(m.size());</code></pre>'
                  ELSE '' END
               || CASE WHEN (conv_id + turn) % 3 = 2 THEN
                    '<p>then call <code>m.get("k' || CAST(conv_id * 100 + turn AS VARCHAR) || '")</code></p>'
                  ELSE '' END AS body,
               CAST(length(text) % 17 AS INTEGER) AS score, turn
        FROM conversations WHERE role = 'assistant'""", ()),
    "comments": ("""
        SELECT conv_id * 100 + turn AS comment_id, conv_id AS post_id, text,
               CAST(length(text) % 5 AS INTEGER) AS score
        FROM conversations WHERE role = 'system'""", ()),
    "postlinks": ("""
        SELECT h.doc_id AS src_id, g.head AS dst_id, 3 AS link_type
        FROM (SELECT doc_id, md5(text) AS h FROM documents) h
        JOIN (SELECT md5(text) AS h, min(doc_id) AS head FROM documents GROUP BY 1) g USING (h)
        WHERE h.doc_id <> g.head
        UNION ALL
        SELECT a.doc_id, b.doc_id, 1 FROM documents a JOIN documents b
          ON b.doc_id = a.doc_id + 20 AND a.source = b.source""", ()),
    "queries": ("SELECT item_id AS query_id, text FROM benchmark", ()),
    # ---- sparse model over questions (title/body fields, idf fitted on body)
    "qfields": ("""
        SELECT post_id, 'title' AS field, title AS text FROM questions
        UNION ALL SELECT post_id, 'body', body FROM questions""", ("questions",)),
    "qtf": (f"""
        SELECT post_id, field, term, count(*) AS tf FROM (
          SELECT post_id, field, unnest(regexp_extract_all(lower(text), '{TOKEN_RE}')) AS term
          FROM qfields) WHERE term NOT IN {STOP_SQL}
        GROUP BY ALL""", ("qfields",)),
    "idf": ("""
        SELECT term, count(*) AS df,
               ln((1.0 + (SELECT count(*) FROM documents)) / (count(*) + 1.0)) + 1.0 AS idf
        FROM qtf WHERE field = 'body' GROUP BY term""", ("qtf",)),
    "postings": ("""
        SELECT post_id, field, term, w / sqrt(sum(w * w) OVER (PARTITION BY post_id, field)) AS weight
        FROM (SELECT post_id, field, term, tf * idf AS w FROM qtf JOIN idf USING (term))""",
                 ("qtf", "idf")),
    "qpost": (f"""
        SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight
        FROM (SELECT query_id, term, tf * idf AS w FROM (
                SELECT query_id, term, count(*) AS tf FROM (
                  SELECT query_id, unnest(regexp_extract_all(lower(text), '{TOKEN_RE}')) AS term
                  FROM queries) WHERE term NOT IN {STOP_SQL} GROUP BY ALL)
              JOIN idf USING (term))""", ("queries", "idf")),
    "sparse_scores": ("""
        SELECT query_id, post_id, round(sum(q.weight * p.weight), 6) AS sim
        FROM qpost q JOIN postings p USING (term) GROUP BY ALL""", ("qpost", "postings")),
    # with the posts that share no term, at 0
    "sparse_all": ("""
        SELECT q.query_id, p.post_id, coalesce(s.sim, 0) AS sim FROM queries q CROSS JOIN questions p
        LEFT JOIN sparse_scores s ON s.query_id = q.query_id AND s.post_id = p.post_id""",
                   ("queries", "questions", "sparse_scores")),
}


def with_ctes(body: str, *names: str, extra: list[tuple[str, str]] | None = None,
              recursive: bool = False) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first), then the
    query-local ``extra`` CTEs (``recursive`` emits WITH RECURSIVE)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    defs = [f"{n} AS ({CTES[n][0]})" for n in order] + [f"{n} AS ({q})" for n, q in (extra or [])]
    if not defs:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(defs) + "\n" + body


def ranked(scores_cte: str, k: int, qid: str = "query_id", pid: str = "post_id") -> str:
    return (f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {qid} "
            f"ORDER BY sim DESC, {pid}) AS INTEGER) AS rank FROM {scores_cte}) WHERE rank <= {k}")


def _wv_dims(tok: str) -> str:
    return ", ".join(
        f"CAST(('0x' || substr(md5({tok}), {4 * i + 1}, 4)) AS INTEGER) / 65535.0 - 0.5 AS v{i}"
        for i in range(8))


CTES.update({
    # fixture word vectors, one column per dim
    "wv": (f"""SELECT token, {_wv_dims('token')} FROM (
        SELECT token FROM (SELECT unnest({space_tokens('text')}) AS token FROM qfields)
        GROUP BY token HAVING count(*) >= 2 UNION ALL SELECT '<unk>')""", ("qfields",)),
    "uwv": (f"""SELECT token, {', '.join(f'v{i} / n AS v{i}' for i in range(8))} FROM (
        SELECT *, sqrt({' + '.join(f'v{i} * v{i}' for i in range(8))}) AS n FROM wv)""", ("wv",)),
    # all tokens of a text; a missing one is <unk>, and so is an empty text
    "dense_docs": (f"""
        SELECT post_id, field, {', '.join(f'avg(coalesce(w.v{i}, u.v{i})) AS v{i}' for i in range(8))}
        FROM (SELECT post_id, field, unnest(CASE WHEN len(a) = 0 THEN ['<unk>'] ELSE a END) AS token
              FROM (SELECT post_id, field, {space_tokens("coalesce(text, '')")} AS a FROM qfields)) f
        LEFT JOIN uwv w ON w.token = f.token, (SELECT * FROM uwv WHERE token = '<unk>') u
        GROUP BY post_id, field""", ("qfields", "uwv")),
    "dense_queries": (f"""
        SELECT query_id, {', '.join(f'avg(coalesce(w.v{i}, u.v{i})) AS v{i}' for i in range(8))}
        FROM (SELECT query_id, unnest(CASE WHEN len(a) = 0 THEN ['<unk>'] ELSE a END) AS token
              FROM (SELECT query_id, {space_tokens("coalesce(text, '')")} AS a FROM queries)) f
        LEFT JOIN uwv w ON w.token = f.token, (SELECT * FROM uwv WHERE token = '<unk>') u
        GROUP BY query_id""", ("queries", "uwv")),
    "dense_raw": (f"""
        SELECT query_id, post_id, sum(
            ({' + '.join(f'q.v{i} * d.v{i}' for i in range(8))})
            / (sqrt({' + '.join(f'q.v{i} * q.v{i}' for i in range(8))})
               * sqrt({' + '.join(f'd.v{i} * d.v{i}' for i in range(8))}))) AS sim
        FROM dense_queries q, dense_docs d GROUP BY query_id, post_id""",
                  ("dense_queries", "dense_docs")),
    "dense_scores": ("SELECT query_id, post_id, round(sim, 6) AS sim FROM dense_raw", ("dense_raw",)),
    "sparse_raw": ("""
        SELECT query_id, post_id, sum(q.weight * p.weight) AS sim
        FROM qpost q JOIN postings p USING (term) GROUP BY ALL""", ("qpost", "postings")),
    "hybrid_scores": ("""
        SELECT query_id, post_id, round(coalesce(d.sim, 0) + coalesce(s.sim, 0), 6) AS sim
        FROM dense_raw d FULL OUTER JOIN sparse_raw s USING (query_id, post_id)""",
                      ("dense_raw", "sparse_raw")),
    # embeddings as a two-field dense index (halves of the vector)
    "emb_knn": ("""
        SELECT a.vec_id AS query_id, b.vec_id AS post_id, round(
            list_cosine_similarity(CAST(a.embedding[1:32] AS DOUBLE[]), CAST(b.embedding[1:32] AS DOUBLE[]))
          + list_cosine_similarity(CAST(a.embedding[33:64] AS DOUBLE[]), CAST(b.embedding[33:64] AS DOUBLE[])),
          6) AS sim
        FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id""", ()),
})
