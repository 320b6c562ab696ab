import datetime as dt
import os

import pytest
from pyspark.sql import functions as F, types as T

from thriftline.operators import clean, quality
from thriftline.operators.contract import FeatureContract, feature_contract, point_in_time_lookup, training_set
from thriftline.plans.workspace import new_path
from thriftline.sources import files, schemas, statements as st, tables


def frame(spark, rows, spec="k int, v string, n double"):
    return spark.createDataFrame(rows, spec)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture()
def pair(spark):
    old = frame(spark, [(1, "a", 1.0), (2, None, 2.0), (3, "c", None), (4, "d", 4.0)])
    new = frame(spark, [(1, "a", 1.0), (2, None, 2.5), (3, None, None), (5, "e", 5.0)])
    return old, new


def test_change_feed_images(pair):
    feed = tables.change_feed(*pair, "k")
    assert sorted((r["_change_type"], r["k"]) for r in feed.collect()) == [
        ("delete", 4), ("insert", 5), ("update_postimage", 2), ("update_postimage", 3), ("update_preimage", 2), ("update_preimage", 3)]
    assert sorted(r["k"] for r in tables.changed_keys(feed, "k").collect()) == [2, 3, 5]


def test_feed_of_equal_snapshots_is_empty(pair):
    assert tables.change_feed(pair[0], pair[0], "k").isEmpty()


def test_applied_feed_gives_the_new_snapshot(pair):
    old, new = pair
    assert rows_of(tables.apply_feed(old, tables.change_feed(old, new, "k"), "k")) == rows_of(new)


def test_feed_sees_a_new_column(spark, pair):
    old, _ = pair
    wider = old.withColumn("extra", F.when(F.col("k") == 1, "x"))
    feed = tables.change_feed(old, wider, "k")
    assert {r["k"] for r in feed.collect()} == {1}


def test_changed_keys_from_digests_equal_those_of_the_feed(pair):
    old, new = pair
    want = tables.changed_keys(tables.change_feed(old, new, "k"), "k")
    assert rows_of(tables.changed_between(old, new, "k")) == rows_of(want)
    assert tables.changed_between(old, old, "k").isEmpty()


def test_increments_give_the_newest_row_per_key(spark, pair):
    path, schema = new_path(spark, "inc"), pair[0].schema
    assert tables.increment_read(spark, path, "k", schema).isEmpty()
    for rows in (pair[0], pair[1], frame(spark, [(5, "again", None), (9, "z", 0.0)])):
        tables.snapshot_write(rows, path)
    got = {r["k"]: (r["v"], r["n"]) for r in tables.increment_read(spark, path, "k", schema).collect()}
    assert got == {1: ("a", 1.0), 2: (None, 2.5), 3: (None, None), 4: ("d", 4.0), 5: ("again", None), 9: ("z", 0.0)}
    tables.compact(spark, path, "k", schema)
    again = {r["k"]: (r["v"], r["n"]) for r in tables.increment_read(spark, path, "k", schema).collect()}
    assert again == got and "Union" not in tables.increment_read(spark, path, "k", schema)._jdf.queryExecution().executedPlan().toString()


def test_writers_never_share_a_version(spark, pair):
    from concurrent.futures import ThreadPoolExecutor
    path = new_path(spark, "shared")
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda i: tables.snapshot_write(pair[i % 2], path), range(4)))
    assert sorted(versions) == [1, 2, 3, 4] == tables.snapshot_versions(spark, path)


def test_upsert_twice_is_upsert_once(pair):
    old, new = pair
    once = tables.merge_upsert(old, new, "k")
    assert rows_of(once) == rows_of(tables.merge_upsert(once, new, "k"))
    assert {r["k"]: r["n"] for r in once.collect()} == {1: 1.0, 2: 2.5, 3: None, 4: 4.0, 5: 5.0}


def test_upsert_refuses_duplicate_source_keys(spark, pair):
    with pytest.raises(ValueError):
        tables.merge_upsert(pair[0], frame(spark, [(9, "a", 1.0), (9, "b", 1.0)]), "k")


def test_snapshots_ignore_uncommitted_versions(spark, pair):
    path = new_path(spark, "snap")
    assert tables.snapshot_write(pair[0], path) == 1 and tables.snapshot_write(pair[1], path) == 2
    os.makedirs(f"{path}/version=3")  # a writer that died
    assert tables.snapshot_versions(spark, path) == [1, 2]
    assert rows_of(tables.snapshot_read(spark, path)) == rows_of(pair[1])
    assert rows_of(tables.snapshot_read(spark, path, 1)) == rows_of(pair[0])
    with pytest.raises(ValueError):
        tables.snapshot_read(spark, path, 3)
    assert tables.snapshot_write(pair[0], path) == 3


def test_constraints_stop_the_write_and_let_null_pass(spark, pair):
    rule = {"small": F.col("n") < 3}
    assert tables.check_constraints(pair[0].filter("k < 4"), rule).count() == 3
    path = new_path(spark, "bad")
    with pytest.raises(Exception, match="constraint violated: small"):
        tables.write_table(tables.check_constraints(pair[0], rule), path)
    assert tables.try_read(spark, path) is None


def test_conform_and_append(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([(1,)], "a int")
    assert tables.conform(df, schema).first() == (1, None)
    with pytest.raises(ValueError):
        tables.conform(df.withColumn("c", F.lit(1)), schema)
    path = new_path(spark, "log")
    assert tables.ensure_table(spark, path, schema).count() == 0
    tables.append_log(df, path, schema)
    tables.append_log(df, path, schema)
    assert tables.ensure_table(spark, path, schema).count() == 2


def test_inventory_reports_missing_tables(spark, pair):
    got = tables.table_inventory({"a": pair[0], "b": None}, spark).collect()
    assert [tuple(r) for r in got] == [("a", 4, True), ("b", 0, False)]


def test_clustered_files_hold_disjoint_key_ranges(spark):
    import pyarrow.parquet as pq
    path = new_path(spark, "clustered")
    df = spark.range(10000).select(F.format_string("u%05d", F.col("id") * 7919 % 10000).alias("user_id"), F.col("id"))
    tables.write_table(tables.cluster_for_lookup(df, ["user_id"], 4), path)
    spans = sorted((lambda c: (c[0].as_py(), c[-1].as_py()))(pq.read_table(os.path.join(path, f), columns=["user_id"])["user_id"])
                   for f in os.listdir(path) if f.endswith(".parquet"))
    assert len(spans) == 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_stats_lookup_defaults(spark):
    stats = spark.createDataFrame([("a", 2.0)], "stat_key string, stat_value double")
    assert spark.range(1).select(tables.stats_lookup(stats, "a", 9.0), tables.stats_lookup(stats, "b", 9.0)).first() == (2.0, 9.0)


# --- files ---------------------------------------------------------------------------
def test_malformed_records_and_values_are_kept(spark, tmp_path):
    (tmp_path / "x.csv").write_text(
        "user_id,date,particulars,chq_num,withdrawal,deposit,balance\n"
        "USR-1,01-01-2024,A,,\"1,000.00\",,5\nUSR-2,01-01-2024,B,,,1,2,too,many\n")
    rows = st.with_ingest_metadata(st.read_statements(spark, str(tmp_path), rescue=True)).orderBy("user_id").collect()
    assert [r["_rescued_data"] for r in rows] == [None, "USR-2,01-01-2024,B,,,1,2,too,many"]
    assert rows[0]["withdrawal"] == "1,000.00" and rows[0]["source_file"].endswith("x.csv")
    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    got = st.rescue_malformed(df, {"a": F.col("a").try_cast("int")}).collect()
    assert [r["_rescued_data"] for r in got] == [None, '{"a":"x"}', None]


def test_schema_evolution_never_drops(spark):
    known = T.StructType.fromDDL("a INT, b STRING")
    seen = T.StructType.fromDDL("b INT, c DOUBLE")
    assert st.evolve_schema(known, seen).simpleString() == "struct<a:int,b:string,c:double>"


def test_json_array_and_inferred_csv(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"scheme_id": 1, "scheme_name": "A", "target_group": "g", "state": "S", "content": "c"}, {"scheme_id": 2}]')
    assert [r["scheme_id"] for r in files.read_json_array(spark, str(tmp_path / "s.json")).orderBy("scheme_id").collect()] == [1, 2]
    (tmp_path / "t.csv").write_text("a,b\n1,2.5\n2,3.5\n")
    df = files.read_csv_inferred(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in df.dtypes] == ["int", "double"]
    assert [t for _, t in files.land_as_string(df).dtypes] == ["string", "string"]


def test_layers_are_created_once(spark, tmp_path):
    for _ in range(2):
        assert files.create_layers(spark, str(tmp_path), ("t_bronze", "t_silver")) == ["t_bronze", "t_silver"]
    assert {"t_bronze", "t_silver"} <= {r[0] for r in spark.sql("SHOW DATABASES").collect()}


# --- quality ----------------------------------------------------------------------------
def rules():
    return [quality.Expectation("positive", F.col("n") > 0, quality.DROP), quality.Expectation("named", F.col("v").isNotNull(), quality.DROP),
            quality.Expectation("small", F.col("n") < 3, quality.WARN)]


def test_kept_and_quarantined_rows_make_up_the_input(spark, pair):
    df = pair[0].unionByName(frame(spark, [(7, None, -1.0)]))
    RULES = rules()
    kept, metrics = quality.expect(df, RULES)
    bad = quality.quarantine(df, RULES)
    assert rows_of(kept.unionByName(bad.drop("broken_rules"))) == rows_of(df)
    assert {r["k"]: r["broken_rules"] for r in bad.collect()} == {2: ["named"], 7: ["positive", "named"]}
    assert {r["rule"]: (r["passed"], r["failed"]) for r in metrics.collect()} == {"positive": (4, 1), "named": (3, 2), "small": (4, 1)}
    assert {r["k"] for r in quality.keep_rows(df, RULES, null_passes=False).collect()} == {1, 4}


def test_fail_rule_stops_before_a_row_is_written(spark, pair):
    path = new_path(spark, "failed")
    rule = [quality.Expectation("all_small", F.col("n") < 3, quality.FAIL)]
    with pytest.raises(Exception, match="expectation failed: all_small"):
        tables.write_table(quality.keep_rows(pair[0], rule), path)
    assert tables.try_read(spark, path) is None


def test_reports(spark, pair):
    assert {r[0]: r[1] for r in quality.null_profile(pair[0]).collect()} == {"k": 0, "v": 1, "n": 1}
    assert tuple(quality.cleaning_summary(pair[0], pair[0].filter("k > 1")).first()) == (4, 3, 1, 25.0)


# --- contract -----------------------------------------------------------------------------
def test_contract_round_trip_and_missing_column(spark):
    contract = FeatureContract()
    assert FeatureContract.from_json(contract.to_json()) == contract and len(contract.features) == 31
    with pytest.raises(ValueError, match="missing from the feature contract"):
        feature_contract(spark.range(1), contract)


def test_training_set_checks_label_and_keys(spark):
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "user_id string, default_label int")
    features = spark.createDataFrame([("a", 0.5)], "user_id string, f double")
    assert rows_of(training_set(labels, features)) == ["Row(user_id='a', default_label=1, f=0.5)", "Row(user_id='b', default_label=0, f=None)"]
    with pytest.raises(ValueError):
        training_set(labels.drop("default_label"), features)
    with pytest.raises(ValueError):
        training_set(labels, features.unionByName(features))


def test_point_in_time_lookup_against_brute_force(spark):
    import random
    draw = random.Random(1)
    day = dt.datetime(2024, 1, 1)
    feats = [("hot" if i % 3 else f"u{i % 5}", day + dt.timedelta(hours=37 * i % 900, seconds=i), i) for i in range(120)]
    labels = [(i, draw.choice(["hot", "u1", "u2", "none"]), day + dt.timedelta(hours=draw.randrange(0, 1000))) for i in range(200)]
    features = spark.createDataFrame(feats, "user string, fts timestamp, f int")
    got = point_in_time_lookup(spark.createDataFrame(labels, "id int, user string, ts timestamp"), features, "user", "ts", "fts")

    def expected(user, ts):
        earlier = [(t, f) for u, t, f in feats if u == user and t <= ts]
        return max(earlier)[1] if earlier else None

    assert {r["id"]: r["f"] for r in got.collect()} == {i: expected(u, t) for i, u, t in labels}


@pytest.mark.parametrize("ranges", [1, 2, 7, 50])
def test_point_in_time_lookup_over_the_ends_of_ranges(spark, ranges):
    """One key with nearly all rows, moments and rows that repeat, NULL keys and times."""
    day = dt.datetime(2024, 1, 1)
    feats = [("hot", day + dt.timedelta(minutes=97 * i), i + 1) for i in range(90)] + [("b", day, 1000), (None, day, 2000), ("c", None, 3000)]
    labels = [(i, "hot", day + dt.timedelta(minutes=13 * i - 50)) for i in range(700)]
    labels += [(1000 + i, "hot", day + dt.timedelta(days=40)) for i in range(300)]  # many at one moment, long after
    labels += [(2000, "b", day), (2000, "b", day), (2001, "c", day), (2002, None, day), (2003, "hot", None), (2004, "none", day)]
    features = spark.createDataFrame(feats, "user string, fts timestamp, f int")
    got = point_in_time_lookup(spark.createDataFrame(labels, "id int, user string, ts timestamp"), features, "user", "ts", "fts", ranges)

    def expected(user, ts):
        earlier = [(t, f) for u, t, f in feats if None not in (u, t, ts) and u == user and t <= ts]
        return max(earlier)[1] if earlier else None

    assert sorted((r["id"], r["f"] or -1) for r in got.collect()) == sorted((i, expected(u, t) or -1) for i, u, t in labels)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    none = point_in_time_lookup(got.select("id", "user", "ts").limit(0), features, "user", "ts", "fts")
    assert none.isEmpty() and none.columns == ["id", "user", "ts", "fts", "f"]


def test_schemas_name_their_keys():
    assert not schemas.CREDIT_SCORES["user_id"].nullable and schemas.STATEMENTS.names[0] == "user_id"


def test_a_null_key_matches_a_null_key(spark):
    target = spark.createDataFrame([(1, "a"), (None, "old"), (3, "c")], "k int, v string")
    source = spark.createDataFrame([(None, "new"), (3, "d"), (4, "e")], "k int, v string")
    found = {(r["k"], r["v"]) for r in tables.merge_upsert(target, source, "k").collect()}
    assert found == {(1, "a"), (None, "new"), (3, "d"), (4, "e")}
    assert tables.merge_upsert(target, target, "k").count() == 3
    assert {r["k"] for r in tables.changed_between(target, source, "k").collect()} == {None, 3, 4}
    kinds = {(r["_change_type"], r["k"]) for r in tables.change_feed(target, source, "k").collect()}
    assert ("update_postimage", None) in kinds and ("insert", None) not in kinds and ("delete", 1) in kinds


def test_a_change_of_a_microsecond_is_found(spark):
    old = spark.sql("SELECT 1 AS k, TIMESTAMP '2026-01-01 00:00:00.000001' AS t, TIMESTAMP_NTZ '2026-01-01 00:00:00.000001' AS n UNION ALL "
                    "SELECT 2, TIMESTAMP '2026-01-01 00:00:00', TIMESTAMP_NTZ '2026-01-01 00:00:00.000001' UNION ALL SELECT 3, NULL, NULL")
    for column in ("t", "n"):
        new = old.withColumn(column, F.when(F.col("k") == 1, F.col(column) + F.expr("INTERVAL 0.000001 SECOND")).otherwise(F.col(column)))
        assert [r["k"] for r in tables.changed_between(old, new, "k").collect()] == [1]
        assert {r["k"] for r in tables.changed_keys(tables.change_feed(old, new, "k"), "k").collect()} == {1}
