"""Text chunks for retrieval, and the texts around a call."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import fixed_values as fv, text

CHUNK_COLUMNS = ["content_type", "source", "title", "state", "content", "chunk_id"]


def corpus_part(df: DataFrame, content_type: str, source: str, title: Column, state: Column, content: Column) -> DataFrame:
    return df.select(
        F.lit(content_type).alias("content_type"), F.lit(source).alias("source"),
        title.cast("string").alias("title"), state.cast("string").alias("state"), content.alias("content"))


def chunk_ids(df: DataFrame) -> DataFrame:
    """An id from the chunk's own values: stable across runs and across batches."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("content_type", "source", "title", "state", "content")]
    return df.withColumn("chunk_id", F.sha2(F.concat_ws("␟", *parts), 256))


def build_corpus(parts: dict[str, DataFrame | None]) -> DataFrame:
    """Union of the parts that exist; no part at all is an error."""
    present = [p for p in parts.values() if p is not None]
    if not present:
        raise ValueError("no source table for the corpus")
    return chunk_ids(reduce(lambda a, b: a.unionByName(b), present)).select(*CHUNK_COLUMNS)


def extend_corpus(corpus: DataFrame, new: DataFrame) -> DataFrame:
    return corpus.unionByName(chunk_ids(new).select(*CHUNK_COLUMNS))


def corpus_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("content_type", "source").agg(F.count("*").alias("chunks")).orderBy(
        F.desc("chunks"), "content_type", "source")


def qa_text(df: DataFrame, topics=fv.FINANCE_TOPICS) -> DataFrame:
    """Question plus the text of the right option; other answers are used as they are."""
    answer = F.col("correct_answer")
    for letter in "ABCD":
        answer = F.when(F.col("correct_answer") == letter, F.col(f"option_{letter.lower()}")).otherwise(answer)
    kept = df.filter(F.col("question").isNotNull() & F.col("topic").isin(*topics))
    return kept.withColumn("rag_text", F.concat(F.lit("Q: "), "question", F.lit(" | Answer: "), answer))


def _whole(column: Column) -> Column:
    return F.round(column, 0).cast("long").cast("string")


def rural_profiles(loans: DataFrame, min_n: int = 5) -> DataFrame:
    """Borrower averages by occupation and city with a readable line; small groups are left out."""
    dependents = F.col("young_dependents") + F.col("old_dependents")
    groups = loans.groupBy(F.col("primary_business").alias("occupation"), "city").agg(
        F.count("*").alias("borrower_count"),
        F.round(F.avg("annual_income"), 0).alias("avg_annual_income"),
        F.round(F.avg("monthly_expenses"), 0).alias("avg_monthly_expenses"),
        F.round(F.avg("loan_amount"), 0).alias("avg_loan_amount"),
        F.round(F.avg("loan_tenure"), 0).alias("avg_loan_tenure"),
        F.round(F.avg(dependents), 1).alias("avg_dependents"),
    ).filter(F.col("borrower_count") >= min_n)
    line = F.concat(
        F.lit("Occupation: "), "occupation", F.lit(" | City: "), "city",
        F.lit(" | Typical borrowers: "), F.col("borrower_count").cast("string"),
        F.lit(" | Average annual income: Rs "), _whole(F.col("avg_annual_income")),
        F.lit(" | Average monthly expenses: Rs "), _whole(F.col("avg_monthly_expenses")),
        F.lit(" | Average loan amount needed: Rs "), _whole(F.col("avg_loan_amount")),
        F.lit(" | Average loan tenure: "), _whole(F.col("avg_loan_tenure")),
        F.lit(" months | Average dependents: "), F.format_string("%.1f", F.col("avg_dependents")))
    return groups.withColumn("rag_text", line)


def profile_chunks(context: DataFrame, min_n: int = 3) -> DataFrame:
    """Score profile per occupation and state as a chunk; groups under ``min_n`` are left out."""
    groups = context.groupBy("occupation", "state").agg(
        F.count("*").alias("n"), F.avg("credit_score").alias("score"), F.avg("annual_income").alias("income"),
        F.avg("total_upi_txns").alias("upi"), F.avg("bill_ontime_rate").alias("ontime"),
    ).filter(F.col("n") >= min_n)
    content = F.concat(
        F.lit("Credit profile for "), "occupation", F.lit(" in "), "state",
        F.lit(": Average score "), _whole(F.col("score")), F.lit("/900. Typical income Rs "), _whole(F.col("income")),
        F.lit("/year. Average UPI transactions: "), _whole(F.col("upi")),
        F.lit(". Bill payment rate: "), _whole(F.col("ontime") * 100),
        F.lit("%. Sample size: "), F.col("n").cast("string"), F.lit(" borrowers."))
    return corpus_part(groups, "score_profile", "scores", F.concat_ws(" - ", "occupation", "state"), F.col("state"), content)


def state_text(df: DataFrame) -> DataFrame:
    """One line of credit context per state."""
    line = F.concat(F.lit("State: "), "state", F.lit(" | Loan accounts: "), F.col("accounts").cast("string"),
                    F.lit(" | Loan amount: Rs "), _whole(F.col("amount")))
    return df.withColumn("rag_text", line)


def scheme_catalogue(spark: SparkSession) -> DataFrame:
    """The 11 schemes with target group and state."""
    rows = [(i, name, "scheme", group, state, words) for i, name, group, state, words in fv.SCHEME_CORPUS]
    return spark.createDataFrame(
        rows, "scheme_id int, scheme_name string, content_type string, target_group string, state string, content string")


def priced_schemes(spark: SparkSession) -> DataFrame:
    """The 12 priced schemes."""
    return spark.createDataFrame(
        list(fv.SCHEME_PRICES),
        "scheme_id string, scheme_name string, max_loan_inr long, interest_pct double, collateral string, eligibility string")


def context_text(hits: DataFrame, n: int = fv.CONTEXT_CHUNKS, chars: int = fv.CONTEXT_CHARS) -> DataFrame:
    """The first n hits of every query as ``- [type] text`` lines; the cut is the prompt's line size."""
    best = hits.filter(F.col("rank") <= n)
    grouped = best.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "content_type", "content"))).alias("_hits"))
    lines = F.transform("_hits", lambda h: F.concat(
        F.lit("- ["), h["content_type"], F.lit("] "), F.substring(h["content"], 1, chars)))
    return grouped.select("query_id", F.array_join(lines, "\n").alias("context"))


def clean_replies(df: DataFrame, column: str = "reply") -> DataFrame:
    return df.withColumn("clean_reply", text.clean_reply(F.col(column)))


def normalise_languages(df: DataFrame, column: str = "raw_language") -> DataFrame:
    coded = df.withColumn("language", text.language_code(F.col(column)))
    return coded.withColumn("language_name", text.language_name(F.col("language")))


SESSION_LOG = T.StructType([
    *[T.StructField(c, T.StringType())
      for c in ("user_id", "user_state", "language", "raw_query", "english_query", "reply", "timestamp")],
    T.StructField("score", T.IntegerType()),
])
