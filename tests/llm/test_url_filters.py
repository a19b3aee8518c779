import random

from peltrane.llm.url_filters import RULES, url_verdicts


def expected(url, rules=RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(h.count("."), len(h), len(p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[4], best[3] if best else "allow"


def test_against_brute_force(spark):
    rng = random.Random(5)
    hosts = ["example.org", "EXAMPLE.org", "a.b.example.org", "org", "xorg", "com", "x.com", "example.org.", "notexample.org", "ÀB.com", "", "org:80", "u@org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/fr/x#y", "/de/", "?q", "#f", "//", "/ES/"]
    urls = [f"{s}{h}{p}" for s in ("http://", "://", "", "a://b://") for h in hosts for p in paths] + [None, "", "://", "x" * 50_000 + "://org/" + "y" * 50_000]
    rows = [(rng.choice([None, 1, k]), u, "h", "d") for k, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, digest string")
    got = sorted((tuple(r) for r in url_verdicts(pages).collect()), key=repr)
    assert got == sorted(((r[0], *expected(r[1])) for r in rows), key=repr)


def test_other_rules_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.x.y/p/q"), (2, None)], "page_id long, url string")
    rules = [("block", "x.y", "/"), ("allow", "a.x.y", ""), ("block", "y", "/p/q")]
    assert sorted(tuple(r) for r in url_verdicts(pages, rules).collect()) == [(1, "a.x.y", "/p/q", "a.x.y", "allow"), (2, "", "", None, "allow")]
    assert {r.verdict for r in url_verdicts(pages, (), default="block").collect()} == {"block"}


def test_short_prefixes_that_collide_are_told_apart_by_digests(spark):
    """With one hex digit most expressions meet rules that aren't theirs; the verdicts stay."""
    pages = spark.createDataFrame([(k, f"http://h{k % 50}.example.org/p{k % 7}/x") for k in range(300)], "page_id long, url string")
    rules = [("block", f"h{k}.example.org", f"/p{k % 7}") for k in range(0, 50, 3)] + [("allow", "example.org", "/p3/")]
    rows = lambda **o: sorted(tuple(r) for r in url_verdicts(pages, rules, **o).collect())
    assert rows(short=1) == rows() == rows(short=64)
    assert {r[3] for r in rows()} >= {None, "example.org/p3/"}


def test_empty(spark):
    assert url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0
