"""Queries on sources, sinks, upserts, change feeds, snapshots and streams."""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv
from ..operators import clean, quality, refresh
from ..plans.workspace import new_path, write_through
from ..sources import buckets, files, schemas, statements as st, tables, zorder
from ..streaming import evolving, feature_state, ingest
from . import inputs, layers, oracle
from .registry import case

# Two snapshots of all orders per customer and priority: what was finished or pending, and what is open or pending
OLD_BOOK, NEW_BOOK = ("F", "P"), ("O", "P")


def activity(spark: SparkSession, d: str, statuses: tuple[str, str]) -> DataFrame:
    """Per customer and priority: orders, value and last order date of the orders in one of the statuses."""
    orders = inputs.table(spark, d, "orders")
    key = F.concat(F.lit("USR-"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderpriority"))
    counted = orders.filter(F.col("o_orderstatus").isin(*statuses))
    return counted.groupBy(key.alias("user_id")).agg(
        F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.max(F.col("o_orderdate").cast("date")).alias("last_order"))


def _activity_sql(statuses: tuple[str, str]) -> str:
    return f"""SELECT 'USR-' || o_custkey || '/' || o_orderpriority AS user_id, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total,
  max(CAST(o_orderdate AS DATE)) AS last_order FROM orders WHERE o_orderstatus IN {statuses} GROUP BY 1"""


oracle.view("v_old", _activity_sql(OLD_BOOK))
oracle.view("v_new", _activity_sql(NEW_BOOK))
_SAME = "o.n_orders = n.n_orders AND o.total = n.total AND o.last_order = n.last_order"


@case("change_feed", "A14", f"""
SELECT 'insert' AS _change_type, n.* FROM v_new n ANTI JOIN v_old o USING (user_id)
UNION ALL SELECT 'delete', o.* FROM v_old o ANTI JOIN v_new n USING (user_id)
UNION ALL SELECT 'update_preimage', o.* FROM v_old o JOIN v_new n USING (user_id) WHERE NOT ({_SAME})
UNION ALL SELECT 'update_postimage', n.* FROM v_old o JOIN v_new n USING (user_id) WHERE NOT ({_SAME})""", total=2)
def _(spark, d):
    return tables.change_feed(activity(spark, d, OLD_BOOK), activity(spark, d, NEW_BOOK), "user_id")


@case("changed_users", "A14 C3", f"""
SELECT n.* FROM v_new n LEFT JOIN v_old o USING (user_id) WHERE o.user_id IS NULL OR NOT ({_SAME})""", total=2)
def _(spark, d):
    old, new = activity(spark, d, OLD_BOOK), activity(spark, d, NEW_BOOK)
    keys = tables.changed_keys(tables.change_feed(old, new, "user_id"), "user_id")
    return refresh.restrict_to_changed(new, keys)


@case("applied_feed", "A14", "SELECT * FROM v_new", total=2)
def _(spark, d):
    old, new = activity(spark, d, OLD_BOOK), activity(spark, d, NEW_BOOK)
    return tables.apply_feed(old, tables.change_feed(old, new, "user_id"), "user_id")


@case("merge_upsert", "A13", "SELECT * FROM v_new UNION ALL SELECT o.* FROM v_old o ANTI JOIN v_new n USING (user_id)", total=2)
def _(spark, d):
    return tables.merge_upsert(activity(spark, d, OLD_BOOK), activity(spark, d, NEW_BOOK), "user_id")


@case("bucketed_upsert", "A13", "SELECT *, 2 AS versions FROM v_new UNION ALL SELECT o.*, 2 FROM v_old o ANTI JOIN v_new n USING (user_id)", total=2)
def _(spark, d):
    """The old snapshot in hash buckets, then the new one upserted into them."""
    path = new_path(spark, "buckets")
    for name, statuses in (("old", OLD_BOOK), ("new", NEW_BOOK)):
        rows = write_through(activity(spark, d, statuses), name)
        version = buckets.bucketed_upsert(rows, path, "user_id", rows.schema, buckets=16)
    return buckets.bucketed_read(spark, path, rows.schema).withColumn("versions", F.lit(version))


@case("bucketed_feed", "A14 A13", f"""
SELECT 'insert' AS _change_type, n.* FROM v_new n ANTI JOIN v_old o USING (user_id)
UNION ALL SELECT 'update_preimage', o.* FROM v_old o JOIN v_new n USING (user_id) WHERE NOT ({_SAME})
UNION ALL SELECT 'update_postimage', n.* FROM v_old o JOIN v_new n USING (user_id) WHERE NOT ({_SAME})""", total=2)
def _(spark, d):
    """What an upsert of the new snapshot into the old one has changed, from the buckets that it wrote."""
    path = new_path(spark, "buckets")
    for name, statuses in (("old", OLD_BOOK), ("new", NEW_BOOK)):
        rows = write_through(activity(spark, d, statuses), name)
        buckets.bucketed_upsert(rows, path, "user_id", rows.schema, buckets=16)
    return buckets.bucketed_feed(spark, path, "user_id", rows.schema, 1)


@case("snapshot_history", "A15", "SELECT 1 AS version, count(*) AS rows FROM v_old UNION ALL SELECT 2, count(*) FROM v_new")
def _(spark, d):
    path = new_path(spark, "activity")
    tables.snapshot_write(activity(spark, d, OLD_BOOK), path)
    tables.snapshot_write(activity(spark, d, NEW_BOOK), path)
    return tables.snapshot_history(spark, path)


@case("snapshot_latest", "A15", "SELECT * FROM v_new", total=2)
def _(spark, d):
    path = new_path(spark, "activity")
    tables.snapshot_write(activity(spark, d, OLD_BOOK), path)
    tables.snapshot_write(activity(spark, d, NEW_BOOK), path)
    return tables.snapshot_read(spark, path)


@case("constraint_report", "A16", "SELECT 'valid_income' AS constraint_name, count(*) FILTER (WHERE NOT (income_monthly > 0 AND income_monthly < 500000)) AS violations FROM v_profiles "
      "UNION ALL SELECT 'valid_bill_rate', count(*) FILTER (WHERE NOT (bill_ontime_rate_24m >= 0 AND bill_ontime_rate_24m <= 1)) FROM v_profiles "
      "UNION ALL SELECT 'valid_default_label', count(*) FILTER (WHERE NOT (default_label = 0 OR default_label = 1)) FROM v_profiles "
      "UNION ALL SELECT 'valid_segment', count(*) FILTER (WHERE segment NOT IN ('shg_woman', 'gig_worker', 'kirana_owner', 'salaried_informal', 'rural_farmer')) FROM v_profiles")
def _(spark, d):
    return tables.constraint_report(inputs.profiles(spark, d), profile_constraints())


def profile_constraints():
    from ..functions import fixed_values as fv
    income, rate, label = F.col("income_monthly"), F.col("bill_ontime_rate_24m"), F.col("default_label")
    return {"valid_income": (income > 0) & (income < fv.MAX_INCOME), "valid_bill_rate": (rate >= 0) & (rate <= 1),
            "valid_default_label": (label == 0) | (label == 1), "valid_segment": F.col("segment").isin(*fv.SEGMENTS)}


@case("constrained_profiles", "A16", "SELECT user_id, segment, income_monthly FROM v_valid_profiles", income_monthly=2)
def _(spark, d):
    checked = tables.check_constraints(clean.clean_profiles(inputs.profiles(spark, d)), profile_constraints())
    return checked.select("user_id", "segment", "income_monthly")


@case("conformed_scores", "A17", "SELECT user_id, segment, score, score_band, default_probability, CAST(NULL AS VARCHAR) AS model_version FROM v_scores")
def _(spark, d):
    path = new_path(spark, "credit_scores")
    tables.ensure_table(spark, path, schemas.CREDIT_SCORES)
    from pyspark.sql import types as T
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schemas.CREDIT_SCORES])
    tables.write_table(tables.conform(inputs.scores(spark, d), nullable), path, "append")
    return tables.ensure_table(spark, path, schemas.CREDIT_SCORES).drop("score_timestamp", "model_run_id")


@case("partitioned_bills", "A12", "SELECT bill_type, count(*) AS n, round(sum(amount), 2) AS total FROM v_clean_bills GROUP BY bill_type", total=1)
def _(spark, d):
    path = new_path(spark, "bills")
    tables.write_table(clean.clean_bills(inputs.bills(spark, d)), path, partition_by=["bill_type"])
    return spark.read.parquet(path).groupBy("bill_type").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@case("partitioned_profiles", "A12", "SELECT segment, count(*) AS n, max(income_monthly) AS highest FROM v_valid_profiles GROUP BY segment", highest=2)
def _(spark, d):
    path = new_path(spark, "profiles")
    tables.write_table(clean.clean_profiles(inputs.profiles(spark, d)), path, partition_by=["segment"])
    return spark.read.parquet(path).groupBy("segment").agg(F.count("*").alias("n"), F.max("income_monthly").alias("highest"))


@case("partitioned_upi", "A12", "SELECT status, count(*) AS n, max(amount) AS highest FROM v_clean_upi GROUP BY status", highest=2)
def _(spark, d):
    path = new_path(spark, "upi")
    rows = clean.clean_upi(inputs.upi(spark, d))
    tables.write_table(rows.select("user_id"), path)
    tables.write_table(rows, path, partition_by=["status"])  # replaces rows and schema
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"), F.max("amount").alias("highest"))


@case("read_json_array", "A10", "SELECT p_partkey, p_name, p_size FROM part")
def _(spark, d):
    """Parts as files that hold one JSON array each, of the parts of a key range."""
    from pyspark.sql import types as T
    path, parts = new_path(spark, "part_json"), inputs.table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    arrays = parts.groupBy(F.floor(F.col("p_partkey") / 500).alias("file")).agg(
        F.to_json(F.collect_list(F.struct(*parts.columns))).alias("value"))
    arrays.write.partitionBy("file").text(path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in parts.schema])
    return files.read_json_array(spark, path, schema).select(*parts.columns)


@case("created_layers", "A20", "SELECT o_orderstatus, count(*) AS n, 3 AS layers FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    """Orders pass from a table in bronze through one in silver to one in gold."""
    orders = inputs.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    made = files.create_layers(spark, new_path(spark, "layers"))
    orders.write.mode("overwrite").saveAsTable("bronze.orders", path=new_path(spark, "bronze_orders"))
    spark.table("bronze.orders").dropDuplicates(["o_orderkey"]).write.mode("overwrite").saveAsTable(
        "silver.orders", path=new_path(spark, "silver_orders"))
    spark.table("silver.orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).write.mode("overwrite").saveAsTable(
        "gold.orders", path=new_path(spark, "gold_orders"))
    return spark.table("gold.orders").withColumn("layers", F.lit(len(made)))


@case("clustered_silver", "A19", "SELECT user_id, date, particulars, clean_balance FROM v_silver", clean_balance=2)
def _(spark, d):
    path = new_path(spark, "clustered")
    rows = layers.silver(spark, d).select("user_id", "date", "particulars", "clean_balance")
    tables.write_table(tables.cluster_for_lookup(rows, ["user_id", "date"]), path)
    return spark.read.parquet(path)


@case("zorder_lookups", "A19", """
SELECT 'user' AS lookup, user_id, date, particulars, clean_balance FROM v_silver WHERE user_id = (SELECT max(user_id) FROM v_silver)
UNION ALL SELECT 'date', user_id, date, particulars, clean_balance FROM v_silver WHERE date = (SELECT max(date) FROM v_silver)
UNION ALL SELECT 'both', user_id, date, particulars, clean_balance FROM v_silver
  WHERE user_id >= (SELECT max(user_id) FROM v_silver WHERE user_id < 'USR-5') AND date >= (SELECT max(date) - 365 FROM v_silver)""",
      clean_balance=2)
def _(spark, d):
    """All statements along the Z-curve, looked up by user, by date and by both."""
    path = new_path(spark, "zorder")
    rows = layers.silver(spark, d).select("user_id", "date", "particulars", "clean_balance")
    ends = zorder.zorder_write(rows, path, ["user_id", "date"]).agg(F.max("high0").alias("user"), F.max("high1").alias("date"))
    user, date = ends.first()
    middle = rows.filter("user_id < 'USR-5'").agg(F.max("user_id")).first()[0]
    lookups = {"user": {"user_id": (user, user)}, "date": {"date": (date, date)},
               "both": {"user_id": (middle, None), "date": (date - timedelta(days=365), None)}}
    return inputs.union_all([
        zorder.zorder_read(spark, path, ranges).select(F.lit(name).alias("lookup"), *rows.columns)
        for name, ranges in lookups.items()])


_SESSION = """
SELECT 'USR-' || u.conv_id AS user_id, CAST(NULL AS VARCHAR) AS user_state, 'hi' AS language, u.text AS raw_query,
  u.text AS english_query, a.text AS reply, CAST(u.turn AS VARCHAR) AS timestamp, 510 AS score
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""


def sessions(spark, d):
    """User turns with the reply that follows, as session log rows."""
    turns = inputs.table(spark, d, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("raw_query"))
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return asked.join(answered, ["conv_id", "turn"]).select(
        F.concat(F.lit("USR-"), F.col("conv_id").cast("string")).alias("user_id"), F.lit(510).alias("score"),
        F.lit("hi").alias("language"), "raw_query", F.col("raw_query").alias("english_query"), "reply",
        F.col("turn").cast("string").alias("timestamp"))


@case("session_log", "A21", _SESSION)
def _(spark, d):
    from ..operators.corpus import SESSION_LOG
    path = new_path(spark, "sessions")
    rows = sessions(spark, d)
    tables.append_log(rows.filter(F.length("raw_query") >= 60), path, SESSION_LOG)
    tables.append_log(rows.filter(F.length("raw_query") < 60), path, SESSION_LOG)
    return tables.ensure_table(spark, path, SESSION_LOG)


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@case("table_inventory", "A22", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows, TRUE AS present FROM {t}" for t in _TABLES)
    + " UNION ALL SELECT 'loan_schemes', 0, FALSE")
def _(spark, d):
    found = {t: tables.try_read(spark, f"{d}/{t}.parquet") for t in [*_TABLES, "loan_schemes"]}
    return tables.table_inventory(found, spark)


@case("calibration_stats", "A23", """
SELECT 'default_rate' AS stat_key, avg(CAST(default_label AS DOUBLE)) AS stat_value FROM v_profiles
UNION ALL SELECT 'upi_avg_amount', avg(amount) FROM v_upi UNION ALL SELECT 'upi_std_amount', stddev_samp(amount) FROM v_upi""", stat_value=4)
def calibration_stats(spark, d):
    upi = inputs.upi(spark, d)
    return tables.calibration_stats({
        "default_rate": (inputs.profiles(spark, d), F.avg("default_label")),
        "upi_avg_amount": (upi, F.avg("amount")), "upi_std_amount": (upi, F.stddev_samp("amount"))})


@case("stats_lookup", "A23", """
SELECT user_id, month, amount / (SELECT avg(amount) FROM v_upi) AS relative_amount, 0.08::DOUBLE AS assumed_rate FROM v_upi""",
      relative_amount=4)
def _(spark, d):
    stats = calibration_stats(spark, d)
    return inputs.upi(spark, d).select(
        "user_id", "month", (F.col("amount") / tables.stats_lookup(stats, "upi_avg_amount", 500.0)).alias("relative_amount"),
        tables.stats_lookup(stats, "missing_rate", 0.08).alias("assumed_rate"))


# --- file sources -----------------------------------------------------------------------
def _statement_files(spark, d) -> str:
    path = new_path(spark, "statement_csv")
    inputs.statements(spark, d).write.option("header", True).csv(path)
    return path


@case("read_statements", "A1", "SELECT * EXCLUDE (chq_num), CAST(NULL AS VARCHAR) AS chq_num FROM v_statements")
def _(spark, d):
    return st.read_statements(spark, _statement_files(spark, d))


@case("ingest_metadata", "A5", "SELECT user_id, count(*) AS n, TRUE AS has_source, 0 AS rescued FROM v_statements GROUP BY user_id")
def _(spark, d):
    rows = st.with_ingest_metadata(st.read_statements(spark, _statement_files(spark, d), rescue=True))
    has = F.col("source_file").endswith(".csv") & F.col("file_modification_time").isNotNull() & F.col("ingestion_timestamp").isNotNull()
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.bool_and(has).alias("has_source"),
                                       F.count("_rescued_data").cast("int").alias("rescued"))


@case("rescued_values", "A4", """
SELECT user_id, date, balance, CASE WHEN TRY_CAST(balance AS DOUBLE) IS NULL THEN '{"balance":"' || balance || '"}' END AS _rescued_data
FROM v_statements""")
def _(spark, d):
    rows = inputs.statements(spark, d).select("user_id", "date", "balance")
    return st.rescue_malformed(rows, {"balance": F.col("balance").try_cast("double")})


_BROKEN_LINE = "particulars LIKE '%EMI%'"


def _files_with_malformed_lines(spark, d) -> str:
    """Statement lines as CSV; a payment of an instalment has one field too many."""
    rows, path = inputs.statements(spark, d), new_path(spark, "malformed_csv")
    quoted = [F.concat(F.lit('"'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in st.STATEMENTS.names]
    line = F.concat(F.concat_ws(",", *quoted), F.when(F.expr(_BROKEN_LINE), ",extra").otherwise(""))
    rows.select(line.alias("value")).write.text(path)
    return path


@case("malformed_records", "A4 B13", f"""
SELECT count(*) FILTER (WHERE {_BROKEN_LINE}) AS rescued, count(*) AS lines,
  count(*) FILTER (WHERE {_BROKEN_LINE}) AS failed_quality FROM v_statements""")
def _(spark, d):
    lines = st.read_statements(spark, _files_with_malformed_lines(spark, d), rescue=True, header=False)
    rows = write_through(lines, "rescued")  # Spark doesn't count broken lines in the files themselves
    whole = F.col("_rescued_data").endswith(",extra")
    rule = [r for r in quality.statement_expectations(layers.AS_OF) if r.name == "high_quality_data"]
    failed = quality.expectation_metrics(clean.parse_date(rows), rule).select(F.col("failed").alias("failed_quality"))
    return rows.agg(F.count_if(whole).alias("rescued"), F.count("*").alias("lines")).withColumn(
        "failed_quality", failed.scalar())


@case("union_evolving", "A3", """
SELECT has_category, has_bill_type, count(*) AS n FROM (
  SELECT category IS NOT NULL AS has_category, FALSE AS has_bill_type FROM v_upi
  UNION ALL SELECT FALSE, bill_type IS NOT NULL FROM v_bills) GROUP BY ALL""")
def _(spark, d):
    both = st.union_evolving(inputs.upi(spark, d), inputs.bills(spark, d))
    return both.groupBy(F.col("category").isNotNull().alias("has_category"), F.col("bill_type").isNotNull().alias("has_bill_type")).agg(
        F.count("*").alias("n"))


@case("read_tagged", "A8", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def _(spark, d):
    path = new_path(spark, "documents")
    tables.write_table(inputs.table(spark, d, "documents").withColumn("part", F.col("lang")).drop("lang"), path, partition_by=["part"])
    tags = [r["part"] for r in spark.read.parquet(path).select("part").distinct().collect()]  # one per folder
    by_language = {lang: f"{path}/part={lang}" for lang in tags}
    return files.read_tagged(spark, by_language).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@case("read_csv_inferred", "A9", "SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes, sum(p_retailprice) AS prices FROM part GROUP BY p_brand", prices=1)
def _(spark, d):
    path = new_path(spark, "part_csv")
    inputs.table(spark, d, "part").write.option("header", True).csv(path)
    parts = files.read_csv_inferred(spark, path)  # sums fail unless the types were inferred
    return parts.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"), F.sum("p_retailprice").alias("prices"))


@case("land_as_string", "A11", """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
  l_returnflag, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped FROM lineitem""")
def _(spark, d):
    return files.land_as_string(inputs.table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", F.col("l_shipdate").cast("date").alias("shipped")))


# --- streams ---------------------------------------------------------------------------------
def _stream_source(rows: DataFrame, label: str) -> tuple[str, int, int]:
    """Statement files as the rows' own partitions, with their number and how many of them make about a third."""
    spark = rows.sparkSession
    path = new_path(spark, label)
    rows.write.option("header", True).csv(path)
    n = len(st.read_statements(spark, path).inputFiles())
    return path, n, -(-n // 3)


def _bronze(spark, d):
    """Stream the statement files into a bronze table; returns table, progress log and the batches that the files make."""
    sink, log = (new_path(spark, name) for name in ("bronze", "bronze_progress"))
    source, n, at_once = _stream_source(inputs.statements(spark, d), "statement_csv")
    ingest.run_available(
        ingest.bronze_stream(spark, source, max_files=at_once), sink, new_path(spark, "bronze_checkpoint"), progress=log)
    return sink, log, -(-n // at_once)


@case("stream_bronze", "A2 A4 A5 A6 S1", "SELECT * EXCLUDE (chq_num), TRUE AS has_source FROM v_statements")
def _(spark, d):
    sink, _log, _batches = _bronze(spark, d)
    return spark.read.parquet(sink).select(
        "user_id", "date", "particulars", "withdrawal", "deposit", "balance", F.col("source_file").isNotNull().alias("has_source"))


@case("stream_progress", "A7", "SELECT count(*) AS input_rows, TRUE AS batches_of_all_files, TRUE AS every_batch_once FROM v_statements")
def _(spark, d):
    _sink, log, batches = _bronze(spark, d)
    return ingest.stream_progress(spark, log).agg(
        F.sum("input_rows").alias("input_rows"), (F.count("*") == batches).alias("batches_of_all_files"),
        (F.count_distinct("batch_id") == F.count("*")).alias("every_batch_once"))


@case("stream_evolving", "A2 A3 A5", """
SELECT * EXCLUDE (balance, chq_num), CASE WHEN substr(date, 7, 4) >= '1995' THEN balance END AS balance,
  CASE WHEN substr(date, 7, 4) >= '1995' THEN 'v2' END AS layout, 2 AS schema_versions FROM v_statements""")
def _(spark, d):
    """Statement files up to 1994 have no balance; later ones have it and a layout mark that no schema declares."""
    source, sink, log, checkpoint = (new_path(spark, name) for name in ("two_layouts", "evolved", "schema_log", "evolving_checkpoint"))
    rows, late = inputs.statements(spark, d).drop("chq_num"), F.substring("date", 7, 4) >= "1995"
    declared = st.STATEMENTS.fromJson({**st.STATEMENTS.jsonValue(), "fields": [
        f for f in st.STATEMENTS.jsonValue()["fields"] if f["name"] not in ("chq_num", "balance")]})
    for part in (rows.filter(~late).drop("balance"), rows.filter(late).withColumn("layout", F.lit("v2"))):
        part.write.mode("append").option("header", True).csv(source)
        evolving.run_evolving(spark, source, sink, log, checkpoint, declared)
    versions = evolving.newest_schema(spark, log)[0]
    return evolving.read_evolved(spark, sink, log).select(
        "user_id", "date", "particulars", "withdrawal", "deposit", "balance", "layout", F.lit(versions).cast("int").alias("schema_versions"))


_RULES = "v_dlt_raw WHERE regexp_matches(user_id, '^USR-[0-9]+$') AND date IS NOT NULL AND (withdrawal IS NOT NULL OR deposit IS NOT NULL) " \
         "AND coalesce(TRY_CAST(regexp_replace(withdrawal, '[^0-9.]', '', 'g') AS DOUBLE) < 10000000, TRUE)"


def _streamed_silver(spark, d, progress: str | None = None) -> DataFrame:
    unsigned = inputs.statements(spark, d).withColumn("balance", F.translate("balance", "-", ""))
    source, _n, at_once = _stream_source(unsigned, "unsigned_csv")
    sink = new_path(spark, "silver")
    rows = ingest.silver_stream(st.stream_statements(spark, source, max_files=at_once), quality.statement_expectations(layers.AS_OF))
    ingest.run_available(rows, sink, new_path(spark, "silver_checkpoint"), progress=progress)
    return spark.read.parquet(sink)


_BROKEN = {
    "critical_no_negative_balance": "TRY_CAST(regexp_replace(balance, '[-,]', '', 'g') AS DOUBLE) >= 0",
    "valid_user_id": "user_id IS NOT NULL AND regexp_matches(user_id, '^USR-[0-9]+$')",
    "valid_date": "date IS NOT NULL",
    "valid_transaction": "withdrawal IS NOT NULL OR deposit IS NOT NULL",
    "realistic_amounts": f"TRY_CAST(regexp_replace(withdrawal, '[^0-9.]', '', 'g') AS DOUBLE) < {fv.LARGEST_WITHDRAWAL}",
    "high_quality_data": "length(user_id) > 0",  # no line of these files has a field too many
    "recent_transactions": f"datediff('day', date, DATE '{layers.AS_OF}') < {fv.FRESH_DAYS}",
    "input_rows": "FALSE",  # counted with them: all rows
}


@case("stream_expectations", "B13 S2", " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE NOT coalesce({test}, TRUE)) AS failed FROM v_dlt_raw" for rule, test in _BROKEN.items()))
def _(spark, d):
    """Rows and broken rules of the stream, summed over its micro-batches from the progress log."""
    log = new_path(spark, "silver_progress")
    _streamed_silver(spark, d, log)
    return ingest.observed_counts(spark, log).groupBy(F.col("name").alias("rule")).agg(F.sum("value").alias("failed"))


@case("stream_silver", "S2", f"""
SELECT user_id, date, particulars, clean_withdrawal, clean_deposit, category, transaction_type, merchant FROM {_RULES}""",
      clean_withdrawal=2, clean_deposit=2)
def _(spark, d):
    return _streamed_silver(spark, d).select(
        "user_id", "date", "particulars", "clean_withdrawal", "clean_deposit", "category", "transaction_type", "merchant")


oracle.view("v_stream", f"SELECT * FROM {_RULES}")
oracle.view("v_stream_personas", oracle.VIEWS["v_dlt_personas"].replace("v_dlt_raw", "v_stream"))
oracle.view("v_stream_final", "SELECT b.*, p.persona FROM v_stream b LEFT JOIN v_stream_personas p ON b.user_id = p.user_id")
oracle.view("v_stream_gold", f"SELECT * EXCLUDE (cv0, income_cv, income_cv_filled), income_cv_filled AS income_cv FROM ({oracle.gold_dlt('v_stream_final')})")


@case("stream_gold", "S3 D8", "SELECT * FROM v_stream_gold", **oracle.DLT_DOUBLES)
def _(spark, d):
    return ingest.gold_from_silver(_streamed_silver(spark, d))


@case("stream_feature_state", "D8 S3 J12", "SELECT * FROM v_stream_gold", **oracle.DLT_DOUBLES)
def _(spark, d):
    """The same table from state: three micro-batches of files by category, so that most users' months come in parts."""
    silver, at = _streamed_silver(spark, d), new_path(spark, "feature_state")
    silver.write.partitionBy("category").parquet(f"{at}/silver")
    files_per_batch = -(-len(spark.read.parquet(f"{at}/silver").inputFiles()) // 3)
    stream = spark.readStream.schema(silver.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{at}/silver")
    query = feature_state.feature_stream(stream, at, f"{at}/checkpoint", buckets=8)
    query.awaitTermination()
    return feature_state.read_features(spark, at, ingest.gold_from_silver(silver).schema)
