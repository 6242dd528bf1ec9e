from collections import defaultdict

import pytest
from compare import compare, connect, rows_of
from pyspark.sql import types as T

from colonnade.llm import links

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      T.StructField("host", T.StringType()), T.StructField("rule", T.LongType())])


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)


def link(*hosts):
    return "".join(f'<a href="https://{h}/x">' for h in hosts)


ROWS = [
    (1, "https://good.com/", link("friend.org", "friend.org", "other.org")),  # allowed by com/
    (2, "http://a.example.com/en/1?x#y", None), (3, "http://www.example.com/en/", ""), (4, "http://b.www.example.com/en", "<p>"),
    (5, "https://bad.net/es/1", link("neutral.org")), (6, "https://linker.org/", link("bad.net", "bad.net")), (7, "https://far.org/", link("linker.org")),
    (8, "https://friend.org/p", "<a href='//other.org/q'><a HREF=HTTP://Third.ORG>"), (9, "https://bad.net/en/", None), (10, None, link("good.com")),
    (11, "no scheme", None), (12, "https://notcom/", None), (13, "https://com", None), (14, "HTTPS://COM/", None), (15, "https://ÄB.COM:8080/en/", None),
    (16, "x://?q", None), (16, "x://?q", None), (17, "https://a.b://c.com/fr/", None), (None, "https://lone.org/\nx", None), (18, "", ""),
]


def brute(rows):
    """Rules and walks from their definitions, over dictionaries."""
    judged, seeds, edges, hosts = [], {"allow": defaultdict(int), "block": defaultdict(int)}, defaultdict(int), set()
    lower = str.maketrans(links.UPPER, links.LOWER)

    def split(url):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        stop = next((i for i, c in enumerate(rest) if i >= end and c in "?#"), len(rest))
        return rest[:end].translate(lower), rest[end:stop]
    import re
    for page, url, html in rows:
        host, path = split(url)
        fits = [r for r in links.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        judged.append((page, host, path, rule))
        if host:
            hosts.add(host)
            if rule:
                seeds[rule.verdict][host] += 1
            for u in re.findall(links.LINK, html or ""):
                target = split("x:" + u if u.startswith("//") else u)[0]
                if target and target != host:
                    edges[host, target] += 1
    tree = set()
    for host in hosts:
        labels = host.split(".")
        tree |= {(".".join(labels[i:]), ".".join(labels[i + 1:])) for i in range(len(labels) - 2)}
    for child, parent in tree:
        edges[child, parent] += 1
        edges[parent, child] += 1

    def walk(seed, edges):
        start = {h: n / sum(seed.values()) for h, n in seed.items()}
        out, score = defaultdict(int), dict(start)
        for (a, _), n in edges.items():
            out[a] += n
        for _ in range(10):
            now = defaultdict(float, {h: 0.15 * x for h, x in start.items()})
            for (a, b), n in edges.items():
                now[b] += 0.85 * score.get(a, 0) * n / out[a]
            score = now
        return score
    trust, distrust = walk(seeds["allow"], edges), walk(seeds["block"], {(b, a): n for (a, b), n in edges.items()})
    for page, host, path, rule in judged:
        d = distrust.get(host, 0) * max(1, len(seeds["block"]))  # in shares of a blocked host's mean score
        yield page, host, path, rule.text if rule else None, rule.verdict if rule else "block" if d >= 1e-9 and d > trust.get(host, 0) * max(1, len(seeds["block"])) else "allow"


def test_equals_brute_force(spark):
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = sorted((tuple(r)[:5] for r in links.filter_urls(pages_of(spark, ROWS)).collect()), key=key)
    assert got == sorted(brute(ROWS), key=key)
    verdicts = {r[0]: r[4] for r in got}
    # who links to a blocked host is blocked, also at two steps; whom a trusted one links to is not
    assert [verdicts[i] for i in (6, 7, 8, 9, 10, 11)] == ["block", "block", "allow", "block", "allow", "allow"]


def test_no_rows_and_no_seeds(spark):
    assert links.filter_urls(pages_of(spark, [])).collect() == []
    rows = links.filter_urls(pages_of(spark, [(1, "https://x.org/", link("y.org"))])).collect()
    assert [(r["verdict"], r["trust"]) for r in rows] == [("allow", 0.0)]


def test_sql(spark, data, tmp_path):
    assert compare(spark, connect(data), "op10_link_propagation", data) is None
    pages = str(tmp_path / "pages.parquet")
    pages_of(spark, [r for r in ROWS if r[0] != 17]).select("page_id", "url", "html").write.parquet(pages)
    con = connect(data)
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{pages}/*.parquet'")
    cur = con.execute(links.oracle())
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    df = links.op10_link_propagation(spark, str(tmp_path))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_plan_is_native(spark, data):
    plan = links.op10_link_propagation(spark, data)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_verdicts_do_not_depend_on_the_number_of_hosts(spark):
    """A hub that 1,300 hosts link to, blocked, alone and beside 100,000 other blocked hosts."""
    rows = [(0, "https://hub.net/es/1", None)] + [(i, f"https://h{i}.org/", link("hub.net")) for i in range(1, 1301)]
    others = spark.range(2000, 102_000).selectExpr("id", "concat('https://b', id, '.net/fr/') url", "cast(null as string) html", "'clash' host", "1L rule")
    for pages in (pages_of(spark, rows), pages_of(spark, rows).unionByName(others.toDF(*PAGES.names))):
        got = links.filter_urls(pages).where("page_id < 2000").groupBy("verdict").count().collect()
        assert [tuple(r) for r in got] == [("block", 1301)]


def test_copies_of_a_graph_keep_its_verdicts(spark):
    rename = lambda t, k: t and t.replace(".org", f"{k}.org").replace("bad.net", f"bad{k}.net").replace("good.com", f"good{k}.com")
    copies = lambda n: [(i, rename(u, k), rename(h, k)) for k in range(n) for i, u, h in ROWS if i in (1, 5, 6, 7, 8)]
    one, many = [{tuple(r) for r in links.filter_urls(pages_of(spark, copies(n))).select("page_id", "verdict").collect()} for n in (1, 30)]
    assert one == many and len(one) == 5
