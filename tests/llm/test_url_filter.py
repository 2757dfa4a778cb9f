import random

import pytest

from sway.llm.queries import RULES
from sway.llm.url_filter import filter_urls, spread

PAGES = "page_id long, url string, html string"


def page(key, url, *links):
    return key, url, "<p>" + " ".join(f'<a class="x" href="{u}">t</a>' for u in links)


def verdicts(spark, rows, rules=RULES, **options):
    docs = spark.createDataFrame(rows, PAGES).selectExpr("*", "'h' host", "'v' verdict", "1 trust")
    return {r.page_id: r for r in filter_urls(docs, rules, **options).collect()}


def test_hosts_paths_and_rules(spark):
    urls = ["HTTP://WWW.Example.NET/en/1?x#y", "http://example.net", "http://a.net/de/", "x://org/fr/a", "http://b.org/fr/x#?",
            "http://b.org/de/", "http://m.example.com/de/9", "http://notexample.com/de/9", "http://a.b://c.net/", None, "no url",
            "", "http:///p/q", "ftp://É.ORG?q=://z.net/", "http://x.net\n/y"]
    got = verdicts(spark, [(i, u, None) for i, u in enumerate(urls)])
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("www.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "", None, "allow"),
        ("a.net", "/de/", "net/", "block"), ("org", "/fr/a", "org/fr/", "allow"), ("b.org", "/fr/x", "org/fr/", "allow"),
        ("b.org", "/de/", None, "allow"), ("m.example.com", "/de/9", "example.com/de/", "block"),
        ("notexample.com", "/de/9", None, "allow"), ("a.b:", "//c.net/", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "/p/q", None, "allow"), ("É.org", "", None, "allow"),
        ("x.net\n", "/y", None, "allow")]


def test_ties_of_rules(spark):
    got = verdicts(spark, [(1, "http://a.b.c/", None), (2, "http://a.b.c/x", None)],
                   [("allow", "b.c/"), ("block", "b.c/"), ("allow", "A.b.c/x")])
    assert (got[1].rule, got[1].verdict) == ("b.c/", "block") and (got[2].rule, got[2].verdict) == ("A.b.c/x", "allow")
    with pytest.raises(ValueError):
        filter_urls(spark.createDataFrame([], PAGES), [("deny", "a/")])


def test_links_carry_trust_and_distrust(spark):
    rows = [
        page(1, "http://farm.com/", "//spam.net/a", "http://SPAM.net/b", "/own"),  # links to a blocked host only
        page(2, "http://feeder.com/", "https://farm.com/x"),
        page(3, "http://fine.com/", "http://a.org/fr/1", "mailto:x@y.z", "sub/page"),
        page(4, "http://a.org/fr/1", "http://cited.com/", "http://mixed.com/"),
        page(5, "http://mixed.com/", "http://spam.net/"),
        page(6, "http://cited.com/"),
        page(7, "http://lone.com/", "http://never-crawled.net/"),
        (8, "http://bare.com/", ""), (None, "http://farm.com/2", None), (9, "http://farm.com/3", "<a\nHREF = 'http://spam.net'>"),
    ]
    got = verdicts(spark, rows, threshold=0.25)
    assert {k: got[k].verdict for k in got if got[k].rule is None} == {
        None: "block", 1: "block", 2: "block", 3: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "block"}
    assert got[6].trust == pytest.approx(0.425) and got[5].trust == pytest.approx(0.425)
    # three pages link to spam.net, two of them on farm.com
    assert got[1].distrust == pytest.approx(0.85 * 2 / 3) and got[5].distrust == pytest.approx(0.85 / 3)
    assert got[2].distrust == pytest.approx(0.85 * got[1].distrust)
    assert got[7].distrust == pytest.approx(0.85)


def test_shares_of_pages_are_seeds(spark):
    rows = [(i, f"http://example.com/{'de' if i < 3 else 'en'}/{i}", None) for i in range(4)]
    rows += [(10 + i, f"http://x.example.com/{'de' if i < 1 else 'en'}/{i}", None) for i in range(4)]
    got = verdicts(spark, rows)
    assert got[3].verdict == "block" and got[3].distrust == 0.75
    assert got[11].verdict == "allow" and got[11].distrust == 0.25


def test_spread_against_power_iteration(spark):
    rng = random.Random(4)
    hosts = [f"h{i}" for i in range(30)]
    edges = {(rng.choice(hosts), "h0" if rng.random() < 0.3 else rng.choice(hosts)): rng.randint(1, 9) for _ in range(120)}
    edges = {e: n for e, n in edges.items() if e[0] != e[1]}
    seeds = {h: (rng.random() if rng.random() < 0.3 else 0.0, rng.random() if rng.random() < 0.3 else 0.0) for h in hosts}
    got = {r.host: (r.trust, r.distrust) for r in spread(
        spark.createDataFrame([(*e, n) for e, n in edges.items()], "source string, target string, n long"),
        spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double"),
        steps=60, least=0.0).collect()}
    for side in (0, 1):
        moves = edges if side == 0 else {(b, a): n for (a, b), n in edges.items()}
        given = {h: sum(n for (a, _), n in moves.items() if a == h) for h in hosts}
        rank = {h: seeds[h][side] for h in hosts}
        for _ in range(60):
            rank = {h: seeds[h][side] + sum(0.85 * rank[a] * n / given[a] for (a, b), n in moves.items() if b == h) for h in hosts}
        for h in hosts:
            assert got.get(h, (0.0, 0.0))[side] == pytest.approx(rank[h], abs=1e-9)


def test_empty_table_and_repeated_rows(spark):
    assert filter_urls(spark.createDataFrame([], PAGES), RULES).count() == 0
    rows = [page(1, "http://a.com/", "http://s.net/")] * 3
    got = filter_urls(spark.createDataFrame(rows, PAGES), RULES).collect()
    assert [(r.page_id, r.verdict) for r in got] == [(1, "block")] * 3
    long = page(2, "http://a.com/" + "p" * 100000, *["http://s.net/"] * 5000)
    assert filter_urls(spark.createDataFrame([long], PAGES), RULES).first().verdict == "block"
