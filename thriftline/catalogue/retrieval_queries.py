"""Queries on the text corpus, retrieval and calls."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import analytics, corpus, retrieval
from . import inputs, oracle
from .pillar_queries import user_credit_context
from .registry import case


# --- corpus -------------------------------------------------------------------------
@case("qa_text", "K3", "SELECT id, topic, lang, rag_text FROM v_qa_text")
def _(spark, d):
    return corpus.qa_text(inputs.finance_qa(spark, d)).select("id", "topic", "lang", "rag_text")


_RURAL = {"avg_annual_income": 0, "avg_monthly_expenses": 0, "avg_loan_amount": 0, "avg_loan_tenure": 0, "avg_dependents": 1}


@case("rural_profiles", "D25", "SELECT * FROM v_rural_profiles", **_RURAL)
def _(spark, d):
    return corpus.rural_profiles(inputs.rural_loans(spark, d))


@case("largest_rural_groups", "D25 (top 10)", """
SELECT occupation, city, borrower_count, avg_annual_income, avg_loan_amount FROM v_rural_profiles
ORDER BY borrower_count DESC, occupation, city LIMIT 10""", avg_annual_income=0, avg_loan_amount=0)
def _(spark, d):
    groups = corpus.rural_profiles(inputs.rural_loans(spark, d))
    return groups.orderBy(F.desc("borrower_count"), "occupation", "city").limit(10).select(
        "occupation", "city", "borrower_count", "avg_annual_income", "avg_loan_amount")


def _parts(spark, d):
    everywhere = F.lit(fv.ALL_STATES)
    return {
        "schemes": corpus.corpus_part(corpus.scheme_catalogue(spark), "loan_scheme", "gov_schemes",
                                      F.col("scheme_name"), everywhere, F.col("content")),
        "qa": corpus.corpus_part(corpus.qa_text(inputs.finance_qa(spark, d)), "finance_qa", "qa_bank",
                                 F.col("question"), everywhere, F.col("rag_text")),
        "rural": corpus.corpus_part(corpus.rural_profiles(inputs.rural_loans(spark, d)), "borrower_profile", "rural_loan",
                                    F.col("occupation"), F.col("city"), F.col("rag_text")),
        "missing": None,
        "states": corpus.corpus_part(corpus.state_text(inputs.state_context(spark, d)), "state_context", "state_loans",
                                     F.col("state"), F.col("state"), F.col("rag_text")),
    }


def _corpus(spark, d):
    return corpus.build_corpus(_parts(spark, d))


@case("corpus", "K1 K2 K13 G1", "SELECT * FROM v_corpus")
def _(spark, d):
    return _corpus(spark, d)


@case("corpus_counts", "D27", "SELECT content_type, source, count(*) AS chunks FROM v_corpus_parts GROUP BY ALL")
def _(spark, d):
    return corpus.corpus_counts(_corpus(spark, d))


oracle.view("v_profile_chunks", """
SELECT 'score_profile' AS content_type, 'scores' AS source, occupation || ' - ' || state AS title, state,
  'Credit profile for ' || occupation || ' in ' || state || ': Average score ' || CAST(round(avg(credit_score), 0) AS BIGINT)
  || '/900. Typical income Rs ' || CAST(round(avg(annual_income), 0) AS BIGINT) || '/year. Average UPI transactions: '
  || CAST(round(avg(total_upi_txns), 0) AS BIGINT) || '. Bill payment rate: ' || CAST(round(avg(bill_ontime_rate) * 100, 0) AS BIGINT)
  || '%. Sample size: ' || count(*) || ' borrowers.' AS content
FROM v_context GROUP BY occupation, state HAVING count(*) >= 3""")


@case("profile_chunks", "D26", "SELECT * FROM v_profile_chunks")
def _(spark, d):
    return corpus.profile_chunks(user_credit_context(spark, d))


@case("extended_corpus_counts", "G2 D27", """
SELECT content_type, source, count(*) AS chunks FROM (SELECT content_type, source FROM v_corpus_parts
  UNION ALL SELECT content_type, source FROM v_profile_chunks) GROUP BY ALL""")
def _(spark, d):
    return corpus.corpus_counts(corpus.extend_corpus(_corpus(spark, d), corpus.profile_chunks(user_credit_context(spark, d))))


# --- vectors --------------------------------------------------------------------------
@case("unit_vectors", "K5", """
SELECT vec_id, i, x / n AS x FROM (
  SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i,
         sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""", x=6)
def _(spark, d):
    units = retrieval.l2_normalise(inputs.table(spark, d, "embeddings"))
    return units.select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


oracle.view("v_state_queries", """
SELECT q.*, s.query_state FROM v_queries q
LEFT JOIN (SELECT target_group AS query_id, min(state) AS query_state FROM v_vectors GROUP BY 1) s USING (query_id)""")


def _state_queries(spark, d):
    states = inputs.vectors(spark, d).groupBy(F.col("target_group").alias("query_id")).agg(F.min("state").alias("query_state"))
    return inputs.label_queries(spark, d).join(states, "query_id", "left")


def _search_sql(k: int, where: str = "TRUE") -> str:
    return f"""
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sim DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, sim, round(round(sim, 3) + CASE WHEN contains(lower(state), lower(query_state)) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 3) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS first FROM (
      SELECT q.query_id, q.query_state, v.chunk_id, v.state, list_cosine_similarity(q.embedding, v.embedding) AS sim
      FROM v_state_queries q, v_vectors v WHERE {where})) WHERE first <= {3 * k})) WHERE rank <= {k}"""


@case("top_k", "K6 E3", _search_sql(5), score=3)
def _(spark, d):
    return retrieval.top_k(_state_queries(spark, d), inputs.vectors(spark, d), 5)


@case("top_k_grid", "K6 (many queries)", _search_sql(5), score=3)
def _(spark, d):
    return retrieval.top_k(_state_queries(spark, d), inputs.vectors(spark, d), 5, query_block=4)  # several blocks


@case("filtered_top_k", "K7", _search_sql(5, "v.state = 'All India' OR v.state = q.query_state OR q.query_state IS NULL"), score=3)
def _(spark, d):
    return retrieval.filtered_top_k(_state_queries(spark, d), inputs.vectors(spark, d), 5)


oracle.view("v_hits", _search_sql(5))
_EVAL = """
SELECT query_id, CAST(max(CASE WHEN rank = 1 AND target_group = expected_group THEN 1 ELSE 0 END) AS INTEGER) AS top1,
  CAST(max(CASE WHEN target_group = expected_group THEN 1 ELSE 0 END) AS INTEGER) AS hit,
  coalesce(1.0::DOUBLE / min(CASE WHEN target_group = expected_group THEN rank END), 0.0::DOUBLE) AS reciprocal_rank
FROM v_hits JOIN v_vectors USING (chunk_id) JOIN v_queries USING (query_id) GROUP BY query_id"""
oracle.view("v_eval", _EVAL)


def _evaluated(spark, d):
    queries, vectors = _state_queries(spark, d), inputs.vectors(spark, d)
    return retrieval.retrieval_eval(retrieval.top_k(queries, vectors, 5), queries, vectors)


@case("retrieval_eval", "K8", "SELECT * FROM v_eval", reciprocal_rank=4)
def _(spark, d):
    return _evaluated(spark, d)


@case("retrieval_summary", "K8", "SELECT count(*) AS queries, avg(top1) AS top1_rate, avg(hit) AS hit_at_k, avg(reciprocal_rank) AS mrr FROM v_eval",
      top1_rate=4, hit_at_k=4, mrr=4)
def _(spark, d):
    return retrieval.eval_summary(_evaluated(spark, d))


# --- embedding ---------------------------------------------------------------------------
@case("embedded_documents", "K4", "SELECT doc_id, lang, 256 AS dims FROM documents")
def _(spark, d):
    texts = inputs.spread(inputs.table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id")
    return retrieval.embed(texts, text_col="text").select("doc_id", "lang", F.size("embedding").alias("dims"))


@case("embedded_corpus_tfidf", "K4 (TF-IDF)", "SELECT doc_id, TRUE AS unit_length FROM documents")
def _(spark, d):
    from ..functions.vectors import norm
    texts = inputs.spread(inputs.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    vectors = retrieval.embed_tfidf(texts, "text", 256)
    length = norm(F.col("embedding"))
    return vectors.select("doc_id", ((F.abs(length - 1.0) < 1e-9) | (length == 0)).alias("unit_length"))


def _document_versions(spark, d):
    """Old and new chunk tables: labelled documents, reviewed and cleaned up.

    Old: every labelled document.  New: toxic ones removed, low-quality ones
    rewritten in lower case, unlabelled documents added.
    """
    labelled = inputs.table(spark, d, "documents").select("doc_id", "text").join(
        inputs.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")),
        "doc_id", "left")
    old = labelled.filter(F.col("quality").isNotNull()).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    new = labelled.filter(F.coalesce("toxic", F.lit(0)) == 0).select(
        F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 0, F.lower("text")).otherwise(F.col("text")).alias("content"))
    return old, new


@case("synced_embeddings", "K9", """
SELECT doc_id AS chunk_id, TRUE AS current FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
WHERE coalesce(toxic, 0) = 0""")
def _(spark, d):
    old, new = _document_versions(spark, d)
    synced = retrieval.sync_embeddings(old, new, retrieval.embed(old).select("chunk_id", "embedding"))
    expected = retrieval.embed(new).select("chunk_id", F.col("embedding").alias("_expected"))
    return synced.join(expected, "chunk_id", "full_outer").select(
        "chunk_id", F.col("embedding").eqNullSafe(F.col("_expected")).alias("current"))


# --- calls ------------------------------------------------------------------------------------
@case("corpus_search_context", "K4 K6 K10")
def _(spark, d):
    chunks = retrieval.embed(_corpus(spark, d)).select("chunk_id", "state", "embedding", "content_type", "content")
    asked = retrieval.embed(inputs.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), text_col="text")
    hits = retrieval.top_k(asked.select("query_id", "embedding"), chunks, 5)
    return corpus.context_text(hits.join(chunks.select("chunk_id", "content_type", "content"), "chunk_id"))


@case("context_text", "K10", """
SELECT query_id, string_agg('- [' || content_type || '] ' || content[1:250], chr(10) ORDER BY rank) AS context FROM (
  SELECT lang AS query_id, source AS content_type, text AS content,
         row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
WHERE rank <= 4 GROUP BY query_id""")
def _(spark, d):
    documents = inputs.table(spark, d, "documents").select(
        F.col("lang").alias("query_id"), F.col("source").alias("content_type"), F.col("text").alias("content"), "n_chars", "doc_id")
    return corpus.context_text(analytics.rank_per_key(documents, "query_id", [F.desc("n_chars"), F.col("doc_id")], 4))


@case("clean_replies", "K11", f"""
SELECT conv_id, turn, role, (CASE WHEN length(visible) > 0 THEN visible ELSE {oracle.quote(fv.FALLBACK_REPLY)} END)[1:490] AS clean_reply FROM (
  SELECT conv_id, turn, role, regexp_replace(regexp_replace(regexp_replace(reply, '<think>.*?</think>', '', 'gs'), '<think>.*', '', 'gs'),
         '^\\s+|\\s+$', '', 'g') AS visible FROM v_replies)""")
def _(spark, d):
    return corpus.clean_replies(inputs.replies(spark, d)).drop("reply")


@case("call_languages", "K12", """
SELECT conv_id, turn, CASE conv_id % 4 WHEN 1 THEN 'ta' WHEN 2 THEN 'en' ELSE 'hi' END AS language,
  CASE conv_id % 4 WHEN 1 THEN 'Tamil' WHEN 2 THEN 'English' ELSE 'Hindi' END AS language_name FROM conversations""")
def _(spark, d):
    return corpus.normalise_languages(inputs.calls(spark, d)).drop("raw_language")
