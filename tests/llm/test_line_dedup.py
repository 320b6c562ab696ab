from collections import defaultdict

import pytest

from thriftline.llm.line_dedup import line_dedup

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, n_lines string, row string, `a.b` int"


def brute(rows, min_chars=10):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                held[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(held[key(x)]) < 2 or min(held[key(x)]) == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


CASES = [
    (1, "A shared line here\nown line one\n\nshort"), (2, "\t a SHARED line here \r\nshort\nÉtat partagé ici"),
    (3, "état partagé ici\nA shared line here\nA shared line here\n"), (4, None), (5, ""), (6, "A shared line here"),
    (7, "twice in one document\ntwice in one document"), (7, "another text of the same id\ntwice in one document"),
    (8, "repeated row, long line"), (8, "repeated row, long line"), (None, "A shared line here"), (9, "x" * 100_000 + "\n" + "x" * 100_000),
    (10, "x" * 100_000), (11, "123456789\n1234567890"), (12, "123456789\n1234567890\n"), (13, "\n" * 3000 + "a long last line"),
    (14, "a long last line"),
]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(d, t, "own", "r", 1) for d, t in CASES], SCHEMA)
    out = line_dedup(docs)
    assert out.columns == ["doc_id", "text", "row", "a.b", "n_lines", "n_dropped"]
    got = sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()], key=repr)
    assert got == brute(CASES)
    assert {r["row"] for r in out.collect()} == {"r"}


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("least", [3, 5])
def test_threshold_counts_documents(spark, least):
    docs = spark.createDataFrame([(i, "held by four documents\nheld by four documents") for i in range(4)], "doc_id long, text string")
    dropped = {r["doc_id"]: r["n_dropped"] for r in line_dedup(docs, min_docs=least).collect()}
    assert dropped == ({0: 0, 1: 2, 2: 2, 3: 2} if least == 3 else {i: 0 for i in range(4)})
