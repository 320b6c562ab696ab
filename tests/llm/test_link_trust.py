import re

import numpy as np

from thriftline.llm.link_trust import RULES, Rule, host_edges, link_trust, propagate, reversed_edges

SCHEMA = "page_id long, url string, html string, host string, trust string"


def page(n, url, *links):
    return n, url, "".join(f'<p>x</p><a class="k" href="{x}">y</a>' for x in links), "clash", "clash"


PAGES = [
    page(1, "http://good.org/a", "https://friend.net/x", "/local", "http://good.org/b"),
    page(2, "http://friend.net/x", "http://second.net/"),
    page(3, "http://second.net/"), page(4, "http://farm.net/1", "http://bad.com/de/1", "//BAD.com/de/2"),
    page(5, "http://bad.com/de/1"), page(6, "http://bad.com/other"), page(7, "http://lonely.net/?q=1"),
    page(8, None), page(9, "no scheme"), page(10, "http://x.example.org/en/12"), page(11, "HTTP://Sub.EXAMPLE.org/es/"),
    page(12, "http://example.org"), page(13, "http://example.org/en/2#f"), page(13, "http://example.org/en/2#f"),
    (14, "http://nohtml.com/fr/x", None, None, None), page(15, "http://notexample.org.net/es/"), page(16, "http://farm.net/2"),
    page(17, "http://a.com/fr/", "http://mixed.net/"), page(18, "http://mixed.net/", "http://bad.com/de/9"), page(19, "ftp://u@h:1?x/://y"),
]


def brute(pages, rounds=20, damping=0.85):
    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        return lower, re.match(r"[^?#]*", rest[len(host):])[0]

    def rule(host, path):
        fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=lambda r: len(r.name), default=None)

    judged = [(p, *split(p[1]), rule(*split(p[1]))) for p in pages]
    links = {}
    for p, host, _, _ in judged:
        for href in re.findall(r'href="([^"]*)"', p[2] or ""):
            href = "http:" + href if href.startswith("//") else href
            to = split(href)[0]
            if host and to and to != host:
                links[host, to] = links.get((host, to), 0) + 1
    names = sorted({h for _, h, _, _ in judged} | {h for pair in links for h in pair})
    at = {h: i for i, h in enumerate(names)}
    forward, back = np.zeros((2, len(names), len(names)))
    for (a, b), n in links.items():
        forward[at[b], at[a]] = n / sum(v for (x, _), v in links.items() if x == a)
        back[at[a], at[b]] = 1 / sum(y == b for _, y in links)
    seeds = np.zeros((2, len(names)))
    for h in names:
        own = [r.verdict for _, x, _, r in judged if x == h and r and h]
        if own:
            seeds[:, at[h]] = own.count("allow") / len(own), own.count("block") / len(own)
    scores = []
    for seed, matrix in zip(seeds, (forward, back)):
        score = (1 - damping) * seed
        for _ in range(rounds):
            score = (1 - damping) * seed + damping * matrix @ score
        scores.append(score)
    out = []
    for p, host, path, r in judged:
        trust, distrust = scores[0][at[host]], scores[1][at[host]]
        out.append((p[0], host, path, r and r.name, r.verdict if r else "block" if distrust > trust else "allow", trust, distrust))
    return out


def test_equals_matrix_iteration(spark):
    got = link_trust(spark.createDataFrame(PAGES, SCHEMA))
    assert got.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict", "trust", "distrust"]
    got = sorted(map(tuple, got.drop("url", "html").collect()), key=lambda r: r[0])
    want = sorted(brute(PAGES), key=lambda r: r[0])
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], atol=1e-4)
    verdict = {r[0]: r[4] for r in got}
    assert verdict[3] == "allow" and verdict[16] == "block" and verdict[6] == "block" and verdict[7] == "allow"
    assert verdict[13] == "allow" and verdict[10] == "block" and verdict[11] == "block"


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert link_trust(empty).collect() == [] and host_edges(empty).collect() == []


def test_longest_rule_wins(spark):
    rules = (Rule("net", "/", "block"), Rule("b.net", "/", "allow"), Rule("net", "/private/", "block"))
    pages = spark.createDataFrame([page(1, "http://a.b.net/x"), page(2, "http://c.net/"), page(3, "http://b.net/private/z")], SCHEMA)
    rows = {r["page_id"]: (r["rule"], r["verdict"]) for r in link_trust(pages, rules).collect()}
    assert rows == {1: ("b.net/", "allow"), 2: ("net/", "block"), 3: ("net/private/", "block")}


def solved(pages, damping=0.85):
    """Distrust of all hosts by a direct solution of the linear system; bad.com/de/ is the only seed."""
    links = {(host_of(u), host_of(x)) for _, u, h, *_ in pages for x in re.findall(r'href="([^"]*)"', h)}
    links = sorted((a, b) for a, b in links if a != b)
    names = sorted({h for pair in links for h in pair})
    back = np.zeros((len(names), len(names)))
    for a, b in links:
        back[names.index(a), names.index(b)] = 1 / sum(y == b for _, y in links)
    seed = np.array([float(h == "bad.com") for h in names])
    return dict(zip(names, np.linalg.solve(np.eye(len(names)) - damping * back, (1 - damping) * seed)))


def host_of(url):
    return url.split("/")[2]


def test_chain_and_ring_equal_a_direct_solution(spark):
    chain = [page(i, f"http://h{i}.net/", f"http://h{i + 1}.net/") for i in range(28)]
    chain += [page(28, "http://h28.net/", "http://bad.com/de/1"), page(29, "http://bad.com/de/1", "http://h25.net/")]
    found = link_trust(spark.createDataFrame(chain, SCHEMA)).collect()
    want = solved(chain)
    assert np.allclose([r["distrust"] for r in found], [want[r["host"]] for r in found], rtol=1e-9, atol=0)
    assert all(r["verdict"] == "block" for r in found)  # h0 is 29 links away


def test_hub_reaches_the_second_hop(spark):
    """Scores however small: 2,000 hosts link to the blocked one, and one of them is linked to; the seed is scaled down."""
    edges = [(f"h{i}.net", "bad.com") for i in range(2000)] + [("far.net", "h7.net")]
    edges = reversed_edges(spark.createDataFrame(edges, "src string, dst string"))
    seeds = spark.createDataFrame([("bad.com", 1e-3)], "host string, seed double")
    scores = {r["host"]: r["score"] for r in propagate(seeds, edges).collect()}
    assert len(scores) == 2002
    assert np.isclose(scores["h7.net"], 0.15 * 1e-3 * 0.85 / 2000, rtol=1e-9)
    assert np.isclose(scores["far.net"], 0.15 * 1e-3 * 0.85 ** 2 / 2000, rtol=1e-9)
