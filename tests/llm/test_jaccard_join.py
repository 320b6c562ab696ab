import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from thriftline.llm import jaccard_join as jj

SCHEMA = "doc_id long, text string, key string, n_links int"


def brute(rows, width=5, threshold=0.8):
    sets = [{tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if (w := (t or "").split()) and d is not None else set()
            for d, t in rows]
    held = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            held[g].append(i)
    common = Counter((a, b) for own in held.values() for k, a in enumerate(own) for b in own[k + 1:])
    links, root = Counter(), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[top(a)] = top(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, least.get(top(i)) if d is not None else None, links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def made_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, n = [], 0

    def add(text):
        nonlocal n
        n += 1
        rows.append((n * 7 % 1009, text))

    for _ in range(60):
        base = [word() for _ in range(rng.randint(30, 200))]
        add(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            add(" ".join(copy))
    base = [word() for _ in range(120)]
    for i in range(90):  # a large group of near copies, and one of exact copies
        copy = list(base)
        for _ in range(rng.randint(1, 2)):
            copy[rng.randrange(120)] = word()
        add(" ".join(copy))
        add("one text that many documents hold, word for word")
    passage = " ".join(word() for _ in range(50))
    for _ in range(60):  # a passage that documents share, which are otherwise different
        add(" ".join(word() for _ in range(150)) + " " + passage)
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "two words"), (2004, "two  words"), (2005, "a"), (None, "two words"),
             (2006, rows[0][1]), (2006, rows[0][1]), (2007, rows[5][1]), (2007, "another text of the same id, of more than five words"),
             (2008, "rep " * 3000), (2009, "rep " * 2000)]
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK_ROWS", block)
    rows = made_rows()
    out = jj.jaccard_join(spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], SCHEMA).repartition(4))
    assert out.columns == ["doc_id", "class_id", "n_links"]
    got, want = sorted(map(tuple, out.collect()), key=repr), brute(rows)
    assert got == want
    assert sum(r[2] > 0 for r in want) > 200


def test_no_links_and_empty(spark):
    rows = [(1, "no two of these texts are alike at all"), (2, "x y z")]
    assert sorted(map(tuple, jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == [(1, 1, 0), (2, 2, 0)]
    assert jj.jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_posterior_bounds():
    """The bounds against a numeric integral of the posterior density."""
    s = np.linspace(0, 1, 20_001)
    for n, least in zip(range(jj.STEP, jj.VALUES + 1, jj.STEP), jj.least_matches()):
        for m, below in ((least, False), (least - 1, True)):
            density = s ** m * (1 - s) ** (n - m)
            assert (density[s >= 0.8].sum() / density.sum() < jj.TOLERANCE) == below
    assert math.isclose(1 - (1 - 0.8 ** jj.BAND_ROWS) ** jj.BANDS, 1, abs_tol=1e-5)


def test_chain_of_links_is_one_component(spark):
    edges = [(i.to_bytes(2, "big"), (i + 1).to_bytes(2, "big")) for i in range(40)] + [(b"\xff\x01", b"\xff\x02")]
    found = jj.components(spark.createDataFrame(edges, "key binary, root binary"))
    labels = {bytes(r["key"]): bytes(r["label"]) for r in found.collect()}
    assert len(labels) == 43 and set(labels.values()) == {b"\x00\x00", b"\xff\x01"}
