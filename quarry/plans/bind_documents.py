"""Document and retrieval bindings: H1-H10, H15-H17, E6/E7, F5, C4, C6, D9, D10, D17."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import WS_CLASS, word_count
from quarry.operators import documents as dm
from quarry.operators.partitioning import ensure_parallelism
from quarry.operators import retrieval as rv
from quarry.operators import summaries as sm
from quarry.plans import fixtures as fx
from quarry.plans.bind_hr import CLEAN_SQL, clean_employees_df
from quarry.plans.catalog import query
from quarry.session import reliable_checkpoint

WORDS_SQL = f"list_filter(regexp_split_to_array(text, '{WS_CLASS}+'), lambda w: w <> '')"

DOC_TYPE_SQL = """CASE WHEN contains(lower(text), 'policy') OR contains(lower(text), 'procedure')
         OR contains(lower(text), 'handbook') THEN 'policy'
       WHEN contains(lower(text), 'budget') OR contains(lower(text), 'financial')
         OR contains(lower(text), 'expense') THEN 'financial'
       WHEN contains(lower(text), 'employee') OR contains(lower(text), 'hr')
         OR contains(lower(text), 'human resources') THEN 'hr'
       ELSE 'general' END"""

COLLECTION_SQL = """CASE WHEN document_type IN ('hr', 'human_resources') THEN 'hr_documents'
       WHEN document_type IN ('finance', 'financial') THEN 'finance_documents'
       ELSE 'general_documents' END"""

CHUNKS_SQL = f"""words AS (SELECT doc_id, text, {WORDS_SQL} AS w FROM documents),
starts AS (SELECT doc_id, w, CASE WHEN len(w) > 0
             THEN range(0, greatest(0, CAST(ceil((len(w) - 512) / 462) AS BIGINT)) * 462 + 1, 462)
             ELSE [] END AS s FROM words),
chunks AS (SELECT doc_id, list_transform(s, lambda x: array_to_string(w[x + 1 : x + 512], ' ')) AS c FROM starts),
chunk_rows AS (SELECT doc_id, len(c) AS total_chunks, unnest(range(len(c))) AS chunk_index,
               unnest(c) AS chunk_text FROM chunks)"""


def docs(spark, sf):
    return ensure_parallelism(fx.table(spark, sf, "documents"))


@query("chunk_documents", "WITH " + CHUNKS_SQL + """
SELECT doc_id, total_chunks, chunk_index, chunk_text FROM chunk_rows""")
def q_chunks(spark, sf):
    return dm.chunk_text(docs(spark, sf), "text", ["doc_id"])


META_SQL = f"""meta AS (SELECT doc_id, source, lang, len({WORDS_SQL}) AS word_count, length(text) AS char_count,
  {DOC_TYPE_SQL} AS document_type FROM documents)"""


@query("doc_metadata", "WITH " + META_SQL + """
SELECT doc_id, word_count, char_count, document_type FROM meta""")
def q_doc_meta(spark, sf):
    return dm.doc_metadata(docs(spark, sf), "text", ["doc_id"])


def chunk_records_df(spark, sf):
    d = docs(spark, sf)
    filename = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return dm.chunk_records(d, "doc_id", "text", filename,
                            {"source": F.col("source"), "lang": F.col("lang")})


@query("chunk_records", "WITH " + CHUNKS_SQL + ",\n" + META_SQL + f"""
SELECT 'doc_' || CAST(c.doc_id AS VARCHAR) || '.txt_' || CAST(chunk_index AS VARCHAR) AS chunk_id,
  c.doc_id, chunk_index, total_chunks, document_type,
  {COLLECTION_SQL} AS collection,
  'doc_' || CAST(c.doc_id AS VARCHAR) || '.txt' AS filename, CAST(word_count AS VARCHAR) AS word_count,
  source, lang
FROM chunk_rows c JOIN meta m ON c.doc_id = m.doc_id""")
def q_chunk_records(spark, sf):
    r = chunk_records_df(spark, sf)
    return r.select("chunk_id", "doc_id", "chunk_index", "total_chunks", "document_type", "collection",
                    F.col("metadata")["filename"].alias("filename"),
                    F.col("metadata")["word_count"].alias("word_count"),
                    F.col("metadata")["source"].alias("source"),
                    F.col("metadata")["lang"].alias("lang"))


@query("collection_route", f"""SELECT doc_id, document_type, {COLLECTION_SQL} AS collection
FROM (SELECT doc_id, {DOC_TYPE_SQL} AS document_type FROM documents)""")
def q_collection_route(spark, sf):
    d = docs(spark, sf).select("doc_id", dm.doc_type(F.col("text")).alias("document_type"))
    return d.withColumn("collection", dm.collection_for(F.col("document_type")))


@query("doc_type_mix", f"""SELECT document_type, count(*) AS documents,
  round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent
FROM (SELECT {DOC_TYPE_SQL} AS document_type FROM documents) GROUP BY document_type""")
def q_doc_type_mix(spark, sf):
    d = docs(spark, sf).select(dm.doc_type(F.col("text")).alias("document_type"))
    return dm.type_mix(d, "document_type")


@query("collection_stats", "WITH " + CHUNKS_SQL + ",\n" + META_SQL + f""",
recs AS (SELECT {COLLECTION_SQL} AS collection FROM chunk_rows c JOIN meta m ON c.doc_id = m.doc_id),
names AS (SELECT * FROM (VALUES ('hr_documents'), ('finance_documents'), ('general_documents')) t(name))
SELECT n.name, coalesce(cnt, 0) AS document_count, 'active' AS status, CAST(NULL AS DOUBLE) AS setting
FROM names n LEFT JOIN (SELECT collection, count(*) AS cnt FROM recs GROUP BY collection) r
  ON n.name = r.collection
UNION ALL SELECT * FROM (VALUES ('max_context_length', CAST(NULL AS BIGINT), 'configuration', 2048.0::DOUBLE),
  ('min_relevance_threshold', NULL, 'configuration', 0.5::DOUBLE), ('max_retrieved_docs', NULL, 'configuration', 5.0::DOUBLE)) t""")
def q_collection_stats(spark, sf):
    per_doc = dm.chunk_counts(docs(spark, sf), "doc_id", "text")
    counts = per_doc.groupBy("collection").agg(F.sum("total_chunks").alias("cnt"))
    names = spark.createDataFrame([(c,) for c in dm.COLLECTIONS], "name string")
    stats = (names.join(counts, names["name"] == counts["collection"], "left")
             .select("name", F.coalesce("cnt", F.lit(0)).alias("document_count"),
                     F.lit("active").alias("status"), F.lit(None).cast("double").alias("setting")))
    settings = spark.createDataFrame([(k, None, "configuration", float(v)) for k, v in rv.SETTINGS.items()],
                                     "name string, document_count bigint, status string, setting double")
    return stats.unionByName(settings)


@query("embed_once", """WITH cache AS (SELECT DISTINCT sha256(d.text) AS text_hash FROM documents d
                     JOIN embeddings e ON e.vec_id = d.doc_id)
SELECT d.doc_id, sha256(d.text) AS text_hash, c.text_hash IS NOT NULL AS from_cache, 64 AS dim
FROM documents d LEFT JOIN cache c ON sha256(d.text) = c.text_hash""")
def q_embed_once(spark, sf):
    d = docs(spark, sf)
    e = fx.table(spark, sf, "embeddings")
    cache = (d.join(e, d["doc_id"] == e["vec_id"]).select(F.sha2("text", 256).alias("text_hash"), "embedding")
             .dropDuplicates(["text_hash"]))
    out = dm.encode_once(d, "doc_id", "text", cache, dm.hashing_encoder(64))
    return out.select("doc_id", "text_hash", "from_cache", F.size("embedding").alias("dim"))


@query("cosine_pairs", """SELECT a.vec_id AS vec_id, b.vec_id AS next_vec_id,
  round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
        / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
           * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def q_cosine_pairs(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    a = e.select("vec_id", F.col("embedding").alias("ea"))
    b = e.select(F.col("vec_id").alias("next_vec_id"), F.col("embedding").alias("eb"),
                 (F.col("vec_id") - 1).alias("vec_id"))
    return a.join(b, "vec_id").select("vec_id", "next_vec_id",
                                      F.round(rv.cosine_similarity("ea", "eb"), 6).alias("cosine"))


DIST_SQL = ("list_sum(list_transform(range(1, len(q.qe) + 1), lambda i: "
            "(CAST(q.qe[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE)) * "
            "(CAST(q.qe[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE))))")


def _topk_sql(corpus_where: str = "") -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings),
d AS (SELECT q.query_id, e.vec_id, {DIST_SQL} AS distance FROM q, embeddings e {corpus_where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, '' AS part, vec_id, rank, round(distance, 6) AS distance,
  round(1 - distance, 6) AS relevance FROM r WHERE rank <= 5"""


def _round_topk(df):
    return df.withColumns({"distance": F.round("distance", 6), "relevance": F.round("relevance", 6),
                           "rank": F.col("rank").cast("long")})


def query_vectors(spark, sf):
    return fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"), "label")


@query("vector_topk", _topk_sql())
def q_vector_topk(spark, sf):
    return _round_topk(rv.vector_topk(query_vectors(spark, sf), fx.table(spark, sf, "embeddings"), 5))


@query("vector_topk_where", _topk_sql("WHERE e.label = 3"))
def q_vector_topk_where(spark, sf):
    corpus = fx.table(spark, sf, "embeddings").filter(F.col("label") == 3)  # metadata filter first
    return _round_topk(rv.vector_topk(query_vectors(spark, sf), corpus, 5))


@query("vector_topk_content", _topk_sql().replace("SELECT query_id, '' AS part, vec_id, rank, round(distance, 6) AS distance,\n  round(1 - distance, 6) AS relevance FROM r WHERE rank <= 5",
    "SELECT r.query_id, r.vec_id, r.rank, round(1 - r.distance, 6) AS relevance, e.label, d.source, d.text AS content FROM r "
    "JOIN embeddings e ON e.vec_id = r.vec_id LEFT JOIN documents d ON d.doc_id = r.vec_id WHERE r.rank <= 5"))
def q_vector_topk_content(spark, sf):
    """Search results with the document's text and the row's metadata."""
    top = rv.vector_topk(query_vectors(spark, sf), fx.table(spark, sf, "embeddings"), 5)
    meta = fx.table(spark, sf, "embeddings").select("vec_id", "label").join(
        docs(spark, sf).select(F.col("doc_id").alias("vec_id"), "source", F.col("text").alias("content")), "vec_id", "left")
    return rv.with_content(top, meta).select("query_id", "vec_id", "rank", F.round("relevance", 6).alias("relevance"), "label", "source", "content")


# requested collection of each query vector, derived from its label; label 9 names a
# collection that does not exist and falls back to the general one
REQUEST_SQL = ("CASE WHEN label <= 2 THEN 'hr_documents' WHEN label <= 5 THEN 'finance_documents' "
               "WHEN label <= 8 THEN 'general_documents' ELSE 'legal_documents' END")

RETRIEVE_SQL = f"""WITH corpus AS (SELECT e.vec_id, e.embedding, d.text,
    CASE WHEN dt IN ('hr', 'human_resources') THEN 'hr_documents'
         WHEN dt IN ('finance', 'financial') THEN 'finance_documents' ELSE 'general_documents' END AS collection
  FROM embeddings e JOIN (SELECT doc_id, text, {DOC_TYPE_SQL} AS dt FROM documents) d ON d.doc_id = e.vec_id),
q AS (SELECT vec_id AS query_id, embedding AS qe,
    CASE WHEN {REQUEST_SQL} IN ('hr_documents', 'finance_documents', 'general_documents')
         THEN {REQUEST_SQL} ELSE 'general_documents' END AS collection FROM embeddings),
d AS (SELECT q.query_id, q.collection, e.vec_id, e.text, {DIST_SQL} AS distance
      FROM q JOIN corpus e ON e.collection = q.collection),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d),
ctx AS (SELECT query_id, collection, vec_id, rank, distance, 1 - distance AS relevance, text
        FROM r WHERE rank <= 5 AND 1 - distance >= 0.5)
"""


def retrieve_context_df(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    d = docs(spark, sf).select(F.col("doc_id").alias("vec_id"), "text")
    corpus = e.join(d, "vec_id").withColumn(
        "collection", dm.collection_for(dm.doc_type(F.col("text")))).select("vec_id", "embedding", "collection")
    names = spark.createDataFrame([(c,) for c in dm.COLLECTIONS], "known string")
    q = query_vectors(spark, sf).withColumn("requested", F.expr(REQUEST_SQL))
    # unknown collection → general: left join against the (small, fixed) collection list
    q = (q.join(F.broadcast(names), q["requested"] == names["known"], "left")
         .withColumn("collection", F.coalesce("known", F.lit(dm.COLLECTION_DEFAULT))))
    top = rv.vector_topk(q, corpus, 5, part_q="collection", part_c="collection")
    return top.filter(F.col("relevance") >= 0.5).withColumnRenamed("part", "collection")


@query("retrieve_context", RETRIEVE_SQL + """SELECT query_id, collection, vec_id, rank,
  round(distance, 6) AS distance, round(relevance, 6) AS relevance FROM ctx""")
def q_retrieve_context(spark, sf):
    return _round_topk(retrieve_context_df(spark, sf))


def budgeted_contexts(spark, sf, ctx=None):
    """Which contexts fit: the budget runs over (query, id, rank, words); no text travels."""
    ctx = ctx if ctx is not None else retrieve_context_df(spark, sf)
    words = docs(spark, sf).select(F.col("doc_id").alias("vec_id"), word_count("text").alias("words"))
    return rv.context_budget(ctx.join(words, "vec_id"), "query_id", "rank", "words", 2048)


BUDGET_CTX_SQL = RETRIEVE_SQL + f""",
wc AS (SELECT *, sum(len({WORDS_SQL.replace('text', 'ctx.text')})) OVER (PARTITION BY query_id ORDER BY rank
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_words_h FROM ctx),
kept AS (SELECT *, CAST(cum_words_h AS BIGINT) AS cum_words FROM wc WHERE cum_words_h <= 2048)
"""


@query("context_budget", BUDGET_CTX_SQL + """SELECT query_id, vec_id, rank, cum_words FROM kept""")
def q_context_budget(spark, sf):
    return budgeted_contexts(spark, sf).select("query_id", "vec_id", "rank", "cum_words")


@query("distinct_sources", BUDGET_CTX_SQL + """SELECT query_id,
  list_sort(list_distinct(list('doc_' || CAST(vec_id AS VARCHAR) || '.txt'))) AS sources,
  count(DISTINCT vec_id) AS n_sources FROM kept GROUP BY query_id""")
def q_distinct_sources(spark, sf):
    kept = budgeted_contexts(spark, sf).withColumn(
        "source", F.concat(F.lit("doc_"), F.col("vec_id").cast("string"), F.lit(".txt")))
    return kept.groupBy("query_id").agg(F.array_sort(F.collect_set("source")).alias("sources"),
                                        F.count_distinct("vec_id").alias("n_sources"))


def _prompt_sql():
    pre, post = rv.PROMPT_WITH_CONTEXT.split("{context}")
    mid, tail = post.split("{query}")
    npre, ntail = rv.PROMPT_NO_CONTEXT.split("{query}")

    def lit(s):
        return "'" + s.replace("'", "''") + "'"
    return BUDGET_CTX_SQL + f""",
agg AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS ctx_text, count(*) AS n
        FROM kept GROUP BY query_id)
SELECT q.vec_id AS query_id, coalesce(a.n, 0) AS n_context,
  CASE WHEN q.vec_id IN (SELECT query_id FROM ctx) THEN {lit(pre)} || coalesce(a.ctx_text, '') || {lit(mid)} || d.text || {lit(tail)}
       ELSE {lit(npre)} || d.text || {lit(ntail)} END AS prompt
FROM embeddings q JOIN documents d ON d.doc_id = q.vec_id LEFT JOIN agg a ON a.query_id = q.vec_id"""


@query("prompt_build", _prompt_sql())
def q_prompt_build(spark, sf):
    ctx = reliable_checkpoint(retrieve_context_df(spark, sf))
    texts = docs(spark, sf).select(F.col("doc_id").alias("vec_id"), "text")
    kept = rv.with_content(budgeted_contexts(spark, sf, ctx), texts)  # texts of the survivors only
    qtext = (fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"))
             .join(docs(spark, sf).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")),
                   "query_id"))
    return rv.build_prompts(qtext, kept, "query_id", "query", "rank", "text", retrieved=ctx)


@query("token_explode", fx.cte("user_queries") + f"""SELECT query_id, len(w) AS total,
  unnest(range(len(w))) AS index, unnest(w) AS token
FROM (SELECT query_id, list_filter(regexp_split_to_array(query, '{WS_CLASS}+'), lambda x: x <> '') AS w
      FROM user_queries)""")
def q_token_explode(spark, sf):
    return dm.token_stream(fx.table(spark, sf, "user_queries"), "query_id", "query")


SEARCH_KEYWORDS = ["policy", "budget", "employee", "license", "the"]


@query("doc_keyword_search", """WITH kw AS (SELECT * FROM (VALUES ('policy'), ('budget'), ('employee'),
  ('license'), ('the')) t(keyword)),
hits AS (SELECT kw.keyword, d.doc_id, d.text, instr(lower(d.text), kw.keyword) AS pos
         FROM kw JOIN documents d ON contains(lower(d.text), kw.keyword)),
agg AS (SELECT keyword, count(*) AS matches, arg_min(doc_id, doc_id) AS first_doc_id,
        arg_min(text, doc_id) AS t, arg_min(pos, doc_id) AS pos FROM hits GROUP BY keyword)
SELECT kw.keyword, (SELECT count(*) FROM documents) AS documents_searched,
  coalesce(matches, 0) AS matches, first_doc_id,
  substring(t, greatest(pos - 60, 1), length(kw.keyword) + 120) AS excerpt
FROM kw LEFT JOIN agg ON kw.keyword = agg.keyword""")
def q_keyword_search(spark, sf):
    return dm.keyword_search(docs(spark, sf), "doc_id", "text", SEARCH_KEYWORDS)


@query("report_text", CLEAN_SQL + """, prof AS (SELECT department, count(employee_id) AS headcount,
  round(avg(salary), 6) AS avg_salary, round(median(salary), 6) AS median_salary,
  min(salary) AS min_salary, max(salary) AS max_salary,
  min(hire_date) AS earliest_hire, max(hire_date) AS latest_hire FROM clean GROUP BY department)
SELECT department, '**Department Profile: ' || department || '**' || chr(10) || chr(10)
  || '**Headcount:** ' || CAST(headcount AS VARCHAR) || chr(10) || chr(10)
  || '**Avg Salary:** ' || CAST(CAST(avg_salary AS DECIMAL(18,2)) AS VARCHAR) || chr(10) || chr(10)
  || '**Median Salary:** ' || CAST(CAST(median_salary AS DECIMAL(18,2)) AS VARCHAR) || chr(10) || chr(10)
  || '**Earliest Hire:** ' || CAST(earliest_hire AS VARCHAR) || chr(10) || chr(10)
  || '**Latest Hire:** ' || CAST(latest_hire AS VARCHAR) || chr(10) || chr(10)
  || '**Salary Range:**' || chr(10) || '• min: ' || CAST(CAST(min_salary AS DECIMAL(18,2)) AS VARCHAR)
  || chr(10) || '• max: ' || CAST(CAST(max_salary AS DECIMAL(18,2)) AS VARCHAR) || chr(10) || chr(10)
  || '**Recommendations:**' || chr(10) || '• Review pay' || chr(10) || '• Plan hiring' AS report
FROM prof""")
def q_report_text(spark, sf):
    prof = sm.department_profile(clean_employees_df(spark, sf))
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("array<string>")
    lines = [("headcount", text("headcount"), none), ("avg_salary", money("avg_salary"), none), ("median_salary", money("median_salary"), none),
             ("earliest_hire", text("earliest_hire"), none), ("latest_hire", text("latest_hire"), none),
             ("salary_range", F.lit(None).cast("string"), F.array(F.concat(F.lit("min: "), money("min_salary")), F.concat(F.lit("max: "), money("max_salary")))),
             ("recommendations", F.lit(None).cast("string"), F.array(F.lit("Review pay"), F.lit("Plan hiring")))]
    tall = prof.select("department", F.explode(F.array(*[
        F.struct(F.lit(i).alias("o"), F.lit(k).alias("k"), v.alias("v"), items.alias("items")) for i, (k, v, items) in enumerate(lines)]))
        .alias("kv")).select("department", "kv.*")
    title = F.concat(F.lit("Department Profile: "), F.col("department"))
    return dm.report_text(tall, ["department"], title, "o", "k", "v", "items")
