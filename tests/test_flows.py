import datetime as dt

from pyspark.sql import functions as F

from thriftline.catalogue import inputs
from thriftline.functions import fixed_values as fv
from thriftline.operators import models, score_tables, statement_features as sf
from thriftline.plans import flows, workspace


def test_flow_equals_the_lazy_form(spark, sf_dir):
    statements = inputs.statements(spark, sf_dir)
    for variant in ("batch", "dlt"):
        stored, lazy = flows.silver_from_statements(statements, variant), sf.silver_transactions(statements, variant)
        assert stored.count() == lazy.count() and stored.select(*lazy.columns).exceptAll(lazy).isEmpty()


def test_statement_and_pillar_flows_end_in_their_tables(spark, sf_dir):
    made = flows.statement_tables(inputs.statements(spark, sf_dir))
    assert len(made["gold"].columns) == 73 and made["dashboard"].columns == score_tables.DASHBOARD_COLUMNS
    assert made["dashboard"].count() == made["gold"].count()
    pillar = flows.pillar_tables(inputs.profiles(spark, sf_dir), inputs.bills(spark, sf_dir), inputs.upi(spark, sf_dir))
    gold = pillar["gold"]
    model = models.train_default_classifier(gold, list(fv.CONTRACT_FEATURES), validation=None, maxIter=2, maxDepth=2)
    scored = flows.scored_tables(model, gold, "v", "r", dt.datetime(2026, 1, 1))
    assert scored["credit_scores"].count() == gold.count() == scored["score_explanations"].count()
    assert scored["credit_scores"].filter(~F.col("score").between(0, 900)).isEmpty()


def test_intermediates_are_dropped(spark):
    import os
    from thriftline.plans.workspace import intermediates, new_path, write_through
    kept = write_through(spark.range(3), "kept")
    with intermediates(spark):
        path = new_path(spark, "inside")
        spark.range(5).write.parquet(path)
        assert write_through(spark.range(4), "inside").count() == 4 and os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://")) and kept.count() == 3


def test_parts_of_gold_follow_the_rows(spark, sf_dir, monkeypatch):
    """The grouping into wide rows gets parts for its rows, and the session its settings back."""
    parts, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    features = sf.statement_features
    monkeypatch.setattr(workspace, "TASK_ROWS", 100)
    monkeypatch.setattr(flows.sf, "statement_features", lambda rows: parts.append((
        int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count())) or features(rows).limit(5))
    flows.statement_tables(inputs.statements(spark, sf_dir))
    (found, rows), = parts
    assert found == -(-rows // 100) > int(before) and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "32m"
