import random

import duckdb

from kilonova.llm import queries
from kilonova.llm.url_rules import judge_urls, rules_frame


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in rules if host and (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if not fits:
        return host, path, None, default
    v, h, p = min(fits, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1], r[2], r[0] != "block"))
    return host, path, h + p, v


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, queries.queries()["op7_url_rules"](spark, sf).collect()))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = sorted(con.sql(queries.oracle_sql()["op7_url_rules"]).fetchall(), key=lambda r: r[0])
    assert [x[0] for x in got] == [x[0] for x in want] and got == want


def test_random_rules_and_urls(spark):
    rnd = random.Random(5)
    labels = ["a", "b", "a-b", "com", "org", "é"]
    host = lambda n: ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, n)))
    path = lambda: "".join(rnd.choice(["/", "/x", "x", "/y/"]) for _ in range(rnd.randint(0, 3)))
    rules = [(rnd.choice(["allow", "block"]), host(3), path()) for _ in range(40)]
    urls = [f"http://{host(5).upper()}{path()}{rnd.choice(['', '?q=/', '#f'])}" for _ in range(500)]
    urls += [None, "", "no scheme", "://", "x://?", "http://a.com:80/x", "http://" + "a." * 3000 + "com/"] + ["http://a.com/x"] * 300
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = judge_urls(pages, rules_frame(spark, rules + rules[:5]), default="block", ranges=13)
    rows = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        assert rows[i] == brute(u, rules, "block"), (u, rows[i])


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(none, rules_frame(spark)).count() == 0
    one = spark.createDataFrame([(None, "http://a.org/")] * 2, "page_id long, url string")
    assert [r.verdict for r in judge_urls(one, rules_frame(spark, [("block", "b", "/")])).collect()] == ["allow"] * 2
