"""The path-template tree against a plain one in Python."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pytest

from passagework.llm import queries, url_filter
from passagework.llm.url_filter import ALPHA, PRIOR, RARE, REJECT, WIDE, Z

from .test_methods import brute_rule

VARIABLE = re.compile(r"(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|(?=[^.]*[0-9])[\w~%-]{6,})(\.[A-Za-z]{1,5})?", re.ASCII)


def general(segment):
    return "*" + (re.search(r"\.[A-Za-z]{1,5}$", segment) or [""])[0]


def brute_tree(urls):
    """host, path -> purity and template, from (host, path) -> set of labels."""
    by_host = defaultdict(list)
    for host, path in urls:
        segments = (path[1:] if path.startswith("/") else path).split("/")
        shape = tuple("*" + (m[1] or "") if (m := VARIABLE.fullmatch(s)) else s for s in segments)
        by_host[host].append([path, shape, shape])
    found = {}
    for host, rows in by_host.items():
        for at in range(max(len(r[1]) for r in rows)):
            seen = defaultdict(lambda: defaultdict(int))
            for _, _, t in rows:
                if len(t) > at:
                    seen[t[:at]][t[at]] += 1
            for r in rows:
                t = r[2]
                if len(t) > at and not t[at].startswith("*"):
                    literal = {c: n for c, n in seen[t[:at]].items() if not c.startswith("*")}
                    if len(literal) >= WIDE and sum(literal.values()) < RARE * len(literal) and literal[t[at]] < RARE:
                        r[2] = (*t[:at], general(t[at]), *t[at + 1 :])
        tree = defaultdict(lambda: defaultdict(lambda: [0, 0]))  # node -> child -> good, labelled
        for path, _, t in rows:
            good, bad = (int(x in urls[host, path]) for x in (1, 0))
            chain = [*(t[:k] for k in range(len(t) + 1)), (*t, None)]
            for parent, child in zip(chain, chain[1:]):
                tree[parent][child][0] += good
                tree[parent][child][1] += good + bad
        for path, _, t in rows:
            estimate = PRIOR
            for k in range(len(t) + 1):
                shares = [g / n for g, n in tree[t[:k]].values() if n]
                estimate = (sum(shares) + ALPHA * estimate) / (len(shares) + ALPHA)
            branches = {c: (g, n) for c, (g, n) in tree[t].items() if n}
            pooled = (sum(g for g, _ in branches.values()) + ALPHA * PRIOR) / (sum(n for _, n in branches.values()) + ALPHA)
            alike = {c for c, (g, n) in branches.items() if abs(g / n - pooled) <= Z * math.sqrt(pooled * (1 - pooled) / n)}
            leaf = (*t, None)
            mine = alike if leaf in alike else {leaf} & set(branches)
            good, n = (sum(branches[c][i] for c in mine) for i in (0, 1))
            found[host, path] = (good + ALPHA * estimate) / (n + ALPHA), "/" + "/".join(t)
    return found


def check(rows, urls, labels):
    """rows by the operator; urls: page_id -> url; labels: (host, path) -> labels."""
    want = brute_tree(labels)
    for r in rows:
        host, path, rule, verdict = brute_rule(urls[r.page_id])
        purity, template = want[host, path]
        assert (r.host, r.path, r.template) == (host, path, template)
        assert r.purity == pytest.approx(purity, abs=1e-9)
        assert r.verdict == (verdict or ("block" if purity < REJECT else "allow"))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_the_query_is_the_plain_tree(spark, size):
    d = f"/root/testdata/{size}"
    urls = dict(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect())
    labels = defaultdict(set)
    for url in urls.values():
        host, path, rule, verdict = brute_rule(url)
        labels[host, path] |= {int(verdict == "allow")} if verdict else set()
    rows = queries.op9_path_templates(spark, d).collect()
    assert len(rows) == len(urls)
    check(rows, urls, labels)
    assert any(r.rule is None and abs(r.purity - PRIOR) > 1e-9 for r in rows)


def _site(r):
    urls, given = {}, {}
    names = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 5))) for _ in range(90)]
    for i in range(700):
        host = r.choice(["a.test", "b.test"])
        path = "/" + "/".join(r.choice([*names, "news", "shop", "shop", "2024", "x.html", "item-8812.htm", ""]) for _ in range(r.randint(0, 12)))
        urls[i] = f"http://{host}{path}?q={i}"
        given[i] = r.choice([None, None, 0, 0, 1] if "shop" in path else [None, 1, 1])
    return urls, given


def _judged(spark, urls, given):
    pages = spark.createDataFrame([(i, urls[i], given[i]) for i in urls], "page_id long, url string, lab int")
    return url_filter.judged(pages, rules=(), label="lab").collect()


def test_a_deep_site_is_the_plain_tree(spark, monkeypatch):
    """Paths of up to twelve segments, merged below the eighth, too, and URLs labelled both ways."""
    import tests.llm.test_templates as here

    for module in (url_filter, here):
        monkeypatch.setattr(module, "WIDE", 6)
    urls, given = _site(random.Random(11))
    urls |= {1000 + i: f"http://a.test/1/2/3/4/5/6/7/8/9/{w}/end" for i, w in enumerate("abcdefghij")}
    given |= {1000 + i: int(i > 6) for i in range(10)}
    labels = defaultdict(set)
    for i, url in urls.items():
        labels[brute_rule(url)[:2]] |= {given[i]} - {None}
    rows = _judged(spark, urls, given)
    want = brute_tree(labels)
    for r in rows:
        purity, template = want[r.host, r.path]
        assert r.template == template and r.purity == pytest.approx(purity, abs=1e-9) and r.verdict == ("block" if purity < REJECT else "allow")
    assert {r.template for r in rows if r.page_id >= 1000} == {"/*/*/*/*/*/*/*/*/*/*/end"}
    assert {r.verdict for r in rows} == {"allow", "block"}


def test_repeated_rows_change_nothing(spark):
    urls, given = _site(random.Random(12))
    urls |= {2000 + i: f"http://c.test/tag/{c}" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    given |= {2000 + i: None for i in range(26)}
    once = {r.page_id: r for r in _judged(spark, urls, given)}
    assert {once[i].template for i in range(2000, 2026)} == {"/tag/*"}
    four = {i + 10_000 * k: urls[i] for i in urls for k in range(4)}
    for r in _judged(spark, four, {i: given[i % 10_000] for i in four}):
        assert r[1:] == once[r.page_id % 10_000][1:]


def test_bad_branches_speak_for_their_siblings(spark):
    """Five bad folders of a host block a sixth; one doesn't, and repeating its URLs doesn't either."""
    rows = [(i, f"http://many.test/{w}/a{k}", 0) for i, w in enumerate(["u", "v", "w", "x", "y"]) for k in "bc"]
    rows += [(10, f"http://one.test/u/a{k}", 0) for k in "bcdefghijklm"]
    rows += [(20, "http://many.test/new/page", None), (30, "http://one.test/new/page", None)]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, lab int"), rules=(), label="lab").collect()}
    assert got[20].verdict == "block" and got[30].verdict == "allow" and got[10].verdict == "block"


def test_a_very_long_url(spark):
    rows = [(1, "http://l.test/" + "seg/" * 3000, None), (2, "http://l.test/" + "x" * 200_000, None), (2, "http://l.test/" + "x" * 200_000, None), (3, None, None)]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, template string")).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"}
