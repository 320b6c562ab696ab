import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from thriftline.llm import setsketch_dedup as sd

SCHEMA = "doc_id long, text string, key string, component_id int, `a.b` string"


def shingle_set(text, width=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width=5, percent=85):
    sets = [shingle_set(t, width) for _, t in rows]
    held = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s if rows[i][0] is not None else ():
            held[g].append(i)
    common = Counter((a, b) for own in held.values() for k, a in enumerate(own) for b in own[k + 1:])
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            root[top(a)] = top(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    component = lambda i: least[top(i)] if rows[i][0] is not None else None
    return sorted(((d, len(sets[i]), component(i), d == component(i)) for i, (d, _) in enumerate(rows)), key=repr)


def made_rows(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeFGHé", k=6))
    rows, n = [], 0

    def add(text):
        nonlocal n
        n += 1
        rows.append((n * 7 % 2003, text))

    for _ in range(60):
        base = [word() for _ in range(rng.randint(30, 200))]
        add(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            add(rng.choice([" ", "\n", "\t "]).join(copy))
    base = [word() for _ in range(300)]
    for i in range(120):  # a large group of near copies, some only linked through others, and one of exact copies
        copy = list(base)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(300)] = word()
        add(" ".join(copy))
        add("one text that many documents hold, word for word")
    chain = [word() for _ in range(200)]
    for _ in range(40):  # each is near the one before
        chain = list(chain)
        chain[rng.randrange(200)] = word()
        add(" ".join(chain))
    passage = " ".join(word() for _ in range(50))
    for _ in range(60):  # a passage that documents share, which are otherwise different
        add(" ".join(word() for _ in range(150)) + " " + passage)
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "two words"), (3004, "TWO \x0b words"), (3005, "a"), (None, "two words"),
             (3006, rows[0][1]), (3006, rows[0][1]), (3007, rows[5][1]), (3007, "another text of the same id, of more than five words"),
             (3008, "rep " * 3000), (3009, "rep " * 2000), (None, None), (3010, "two words"), (3011, "x" * 100_000)]
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(sd, "BLOCK_ROWS", block)
    monkeypatch.setattr(sd, "HUB_ROWS", block // 2)
    rows = made_rows(block)
    found = sd.near_dedup(spark.createDataFrame([(d, t, "clash", 0, "x") for d, t in rows], SCHEMA).repartition(4))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted(((d, n, c, bool(k)) for d, n, c, k in found.collect() if d is not None), key=repr)
    assert got == [r for r in brute(rows) if r[0] is not None]
    assert [(c, k) for d, _, c, k in found.collect() if d is None] == [(None, True)] * 2


def test_cells_find_what_hubs_do_not(spark, monkeypatch):
    """Without the hubs' links the cells alone connect the same documents."""
    monkeypatch.setattr(sd, "confirmed_hubs", lambda pairs, *_: pairs.sparkSession.createDataFrame([], sd.EDGES))
    monkeypatch.setattr(sd, "BLOCK_ROWS", 32)
    rows = [r for r in made_rows() if r[0] is not None]
    found = sd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_empty_and_alone(spark):
    assert sd.near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "no two of these texts are alike at all"), (2, "x y z"), (3, None)]
    found = sd.near_dedup(spark.createDataFrame(rows, "doc_id int, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, 5, 1, True), (2, 1, 2, True), (3, 0, 3, True)]


def pairs_of(similarity, size, n, seed):
    """Registers of ``n`` pairs of sets of about ``size`` elements."""
    rng = np.random.default_rng(seed)
    common = round(2 * size * similarity / (1 + similarity))
    a, b, sizes = [], [], []
    for _ in range(n):
        own = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.int64).astype(np.uint64)
        x, y = own[:size], np.concatenate([own[:common], own[size:]])
        a.append(sd.registers(sd.minima(x)))
        b.append(sd.registers(sd.minima(y)))
        sizes.append((len(x), len(y)))
    return np.array(a), np.array(b), *np.array(sizes).T


@pytest.mark.parametrize("similarity", [0.2, 0.5, 0.85, 0.95])
def test_likelihood_estimates_similarity(similarity):
    a, b, n_a, n_b = pairs_of(similarity, 400, 300, 7)
    found = sd.estimate(*sd.compared(a, b, n_a, n_b))
    assert abs(found.mean() - similarity) < 0.015
    assert found.std() < 1.2 * (similarity * (1 - similarity) / sd.REGISTERS) ** 0.5 + 0.002
    kept = sd.may_reach(a, b, n_a, n_b, 0.85)
    assert kept.all() if similarity >= 0.85 else kept.mean() < 0.05


def test_estimate_is_the_peak():
    """Golden section against a grid over all similarities."""
    grid = np.linspace(0, 1, 2001)
    for more, less, u in ((10, 5, 0.5), (0, 0, 0.5), (30, 2, 0.55), (2, 40, 0.4), (48, 48, 0.5)):
        inside = grid[grid <= min(u / (1 - u), (1 - u) / u)]
        best = inside[np.argmax(sd.log_likelihood(inside, np.full(len(inside), more), np.full(len(inside), less), np.full(len(inside), u)))]
        assert abs(sd.estimate(np.array([more]), np.array([less]), np.array([u]))[0] - best) < 2e-3


def test_registers_merge():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64) for _ in range(2))
    union = sd.registers(sd.minima(np.concatenate([a, b])))
    assert (sd.merged(sd.registers(sd.minima(a)), sd.registers(sd.minima(b))) == union).all()
    assert 1 - (1 - 0.85 ** sd.BAND_ROWS) ** sd.BANDS > 1 - 3e-8
