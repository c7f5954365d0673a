import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb

from kilonova.llm import queries
from kilonova.llm.filter_audit import coalition_values, filter_audit, order_sums
from tools.oracle_check import compare


def failing(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {f for f, bad in zip("ABCD", [len(w) < 200, 100 * len(set(w)) < 50 * len(w),
                                         100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search("[#$%&*|]", text)]) if bad}


def brute(docs, labels):
    """The definitions, document by document and order by order."""
    first, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if x == 1 else set()
    parts = defaultdict(list)
    for i, t, lang in docs:
        parts[lang or ""].append((i, failing(t or "") | ({"E"} if i is not None and i > first[t or ""] else set())))
    out, total = {}, Counter()
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[part, f] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows),
                    sum(r[0] is not None and r[0] in good for r in gone), sum(r[0] is not None and r[0] in toxic for r in gone))
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_potential_is_the_mean_over_orders():
    counts = {0: 5, 1: 3, 3: 2, 6: 4, 7: 1, 4: 9}
    v = coalition_values(counts, 3)
    assert v == [sum(c for m, c in counts.items() if m & s) for s in range(8)]
    want = [0] * 3
    for order in permutations(range(3)):
        s = 0
        for k in order:
            want[k] += v[s | 1 << k] - v[s]
            s |= 1 << k
    assert order_sums(v, 3) == want


def test_query_equals_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = queries.queries()["op11_filter_audit"](spark, sf)
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert result(df) == brute(docs, labels)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    res = compare(df.toPandas(), con.execute(queries.oracle_sql()["op11_filter_audit"]).df(), dict(df.dtypes))
    assert res["columns_match"] and not res["dtype_diff"] and res["cells_tol_diff"] == 0 and res["rows_spark"] == res["rows_duckdb"], res


LONG = " ".join(f"w{i}" for i in range(300))
DOCS = [(1, None, "en"), (2, "", "en"), (3, LONG, None), (4, LONG, ""), (4, LONG, ""), (None, LONG, "en"), (None, None, None),
        (5, "A" * 50_000 + " # ", "de"), (6, "a a b\x0bA", "en"), (7, (LONG + "\n") * 300, "de"), (2, "é" * 7 + "É", "en")]
LABELS = [(1, 1, 0), (1, 0, 1), (4, None, 1), (None, 1, 1), (5, 1, None), (99, 1, 1), (2, None, None)]


def test_odd_rows(spark):
    cols = "doc_id long, text string, lang string, part string, mask int, n long, key string, digest string, words string, good int"
    docs = spark.createDataFrame([(*d, "x", 3, 7, "k", "d", "w", 1) for d in DOCS], cols)
    labels = spark.createDataFrame([(*x, "k", "m") for x in LABELS], "doc_id long, quality int, toxic int, key string, mask string")
    assert result(filter_audit(docs, labels)) == brute(DOCS, LABELS)
    none = docs.where("false")
    assert filter_audit(none, labels).count() == 0
    got = result(filter_audit(docs, labels.where("false")))
    assert got == brute(DOCS, [])


def test_repeated_and_hot_rows(spark):
    rows = [(i, "same text", "en") for i in range(500)] + [(7, "same text", "en")] * 400 + [(None, "x", "fr")] * 300
    df = filter_audit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7),
                      spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int"))
    assert result(df) == brute(rows, [(7, 1, 0)])
