import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from thriftline.llm import importance_resampling as ir

SCHEMA = "doc_id long, text string, score string, rank int, `a.b` string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i:i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)], len(words)


def brute(rows, target, width=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in features(text, width)[0]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log(((b + 1) * (sum(s) + buckets)) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for doc, text in rows:
        own, n_words = features(text, width)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()[:8], 16)
        score = None if doc is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(own), weight, score, None, n_words])
    usual = sorted((r for r in out if r[0] is not None and r[5] >= min_words), key=lambda r: (-r[3], r[0], r[1]))
    for rank, r in enumerate(usual[:percent * len(usual) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def made_rows(n=400):
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "über", "x1", "1984", "naïve", "日本語", "q"] + ["w%d" % i for i in range(300)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))
    rows = [(i * 37 % 5003 - 1000, text()) for i in range(n)]
    one = "the very same text " * 6
    rows += [(6000 + i, one) for i in range(200)] + [(6000, one), (6000, one), (6000, one + "more")]
    rows += [(7000, None), (7001, ""), (7002, " .,;\n"), (None, one), (7003, "long " * 50_000), (7004, "x" * 200_000), (7005, "A\x00b\x7fC-d_e")]
    return rows, [text() for _ in range(40)] + [None, ""]


@pytest.mark.parametrize("width,percent", [(1, 10), (2, 37), (1, 100), (3, 0)])
def test_equals_brute_force(spark, width, percent, monkeypatch):
    rows, target = made_rows()
    docs = spark.createDataFrame([(*r, "own", 1, "x") for r in rows], SCHEMA).repartition(5)
    found = ir.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), width=width, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in found.dtypes} == {"bigint"}
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, target, width, percent=percent)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ir.resample(none, none).collect() == []
    rows = [(i, "some words " * 15) for i in range(30)]
    found = ir.resample(spark.createDataFrame(rows, "doc_id long, text string"), none)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, [])


def test_one_score_is_ranked_in_ranges(spark):
    """All rows have one score: ranks follow the ids."""
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 - 500 AS id", "30L AS n_words", "30L AS n_features", "0L AS weight", "5L AS score")
    found = {r["id"]: r["rank"] for r in ir.ranked(rows.repartition(7), rows["n_words"] >= 20, 33).collect()}
    assert found == {i - 500: i + 1 if i < 330 else None for i in range(1000)}


def test_crc_matrices_equal_the_library():
    rng = np.random.default_rng(0)
    values = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in [*range(70), *rng.integers(0, 40, 500), 100_000]]
    array = pa.array(values, pa.large_binary())
    assert ir.crc32(array).tolist() == [zlib.crc32(v) for v in values]
    assert ir.crc32(array.slice(5, 50)).tolist() == [zlib.crc32(v) for v in values[5:55]]
    assert ir.crc32(pa.array([], pa.large_binary())).tolist() == []


def test_large_batches_are_cut(monkeypatch):
    monkeypatch.setattr(ir, "TEXT_BYTES", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["word " * (i % 30) for i in range(50)])], ["id", "text"])
    parts = list(ir._chunks([batch], 1))
    assert sum((p.column(0).to_pylist() for p in parts), []) == list(range(50))
    assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= 100 for p in parts) and len(parts) > 10


def test_draws_follow_the_target(spark):
    """Documents of the target's words are drawn far more often than others."""
    rng = random.Random(1)
    text = lambda kind: " ".join(f"{kind}{rng.randrange(50)}" for _ in range(40))
    rows = [(i, text("a" if i % 5 else "b")) for i in range(1000)]
    found = ir.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(text("b"),) for _ in range(20)], "text string"))
    drawn = [r["doc_id"] for r in found.filter("rank IS NOT NULL").collect()]
    assert len(drawn) == 100 and sum(d % 5 == 0 for d in drawn) > 60
