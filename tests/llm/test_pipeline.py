import zlib

import corpus_pipeline as cp
import __spark_entry__ as entry
import duckdb
import pytest

from test_oracle import TABLES, content
from thriftline.llm import lp_packing
from thriftline.llm.oracle import ORACLE_SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert content(entry.queries()[name](spark, sf_dir).toArrow()) == content(con.sql(ORACLE_SQL[name]).to_arrow_table())


def test_names():
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in entry.queries()} and "pipeline" in entry.queries()
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "shared_lines", "near_duplicates", "packing"]


CLEAN = " ".join(f"Word{i} goes with number{i}" for i in range(60))
NEAR = CLEAN.replace("Word7 ", "Other7 ")
DOCS = [
    (1, CLEAN), (2, NEAR), (3, CLEAN), (4, None), (5, ""), (6, "too short"), (7, "same words again " * 200), (8, CLEAN[::-1]),
    (9, CLEAN[::-1] + "\na line of its own that is long"), (10, "\n".join([CLEAN[40:600], CLEAN[::-1]])), (8, CLEAN[::-1]), (None, CLEAN[5:]),
]


def test_stages(spark):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in DOCS], "doc_id long, text string, lang string, source string, n_chars long")
    frames = {}
    rows = docs
    for name, stage in cp.STAGES:
        rows = cp.write_through(stage(spark, rows, ""), name)
        frames[name] = rows
        if name != "packing":
            assert rows.columns == docs.columns
    ids = {name: sorted((r["doc_id"] for r in f.collect()), key=repr) for name, f in frames.items()}
    assert ids["quality_rules"] == [1, 10, 2, 3, 8, 8, 9, None]
    texts = {r["doc_id"]: r["text"] for r in frames["shared_lines"].collect()}
    assert texts[1] == CLEAN and texts[2] == NEAR and texts[3] == "" and texts[9] == "a line of its own that is long"
    assert texts[10] == CLEAN[40:600] and all(r["n_chars"] == len(r["text"]) for r in frames["shared_lines"].collect())
    assert ids["near_duplicates"] == [1, 10, 3, 8, 9, None]
    assert {r["doc_id"] for r in frames["packing"].collect()} == {1, 3, 8, 9, 10, None}


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_sequences_can_be_rebuilt(spark, tmp_path):
    """The last stage's rows alone give every sequence, and those give the cleaned texts' ids."""
    docs = [(i, " ".join(f"Word{i}x{k} goes with number{k}" for k in range(60)), "en", "s", 0) for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = cp.run(spark, str(tmp_path)).collect()
    path = cp.public_tokenizers.path("word_bpe_49k.json")
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert 4 * r["offset"] == len(sequences.get(r["sequence_id"], b"")) and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences[r["sequence_id"]] = sequences.get(r["sequence_id"], b"") + r["ids"]
    assert {r["doc_id"] for r in rows} == {d[0] for d in docs}
    for doc_id, text, *_ in docs:
        own = [r for r in rows if r["doc_id"] == doc_id]
        cut = [sequences[r["sequence_id"]][4 * r["offset"]:][:4 * r["length"]] for r in sorted(own, key=lambda r: r["start"])]
        assert b"".join(cut) == cp.lp_packing.encode(text, path)


def test_packing_query_runs_with_ids(spark, sf_dir, monkeypatch):
    made, pack = [], lp_packing.pack_documents
    monkeypatch.setattr(lp_packing, "pack_documents", lambda *a, **k: made.append(pack(*a, **k)) or made[-1])
    out = entry.queries()["op8_lp_packing"](spark, sf_dir)
    assert "ids" in made[0].columns and out.columns == [c for c in made[0].columns if c != "ids"]
    key = ["doc_id", "piece", "ids_crc32"]
    assert sorted(map(tuple, out.select(*key).collect())) == sorted(map(tuple, made[0].select(*key).collect()))


def test_columns_of_any_name_come_through(spark):
    """Extra columns named like the operators' own keep their values."""
    extra = ["kept", "rejected_by", "n_lines", "n_dropped", "same", "n_words", "input_2", "a.b"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    docs = spark.createDataFrame([(d, t, 0, *[f"{c} of {d}" for c in extra]) for d, t in DOCS], schema)
    rows = docs
    for name, stage in cp.STAGES[:-1]:
        rows = cp.write_through(stage(spark, rows, ""), name)
        assert rows.columns == docs.columns
    assert sorted((r["doc_id"] for r in rows.collect()), key=repr) == [1, 10, 3, 8, 9, None]
    assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows.collect() for c in extra)
