import hashlib
import re

from kilonova.llm.secret_scan import find, mask_secrets, secret_report, secret_spans

COLS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def digest(spans):
    s = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
    return hashlib.sha256(s.encode()).hexdigest()


def test_base_spans_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in secret_report(docs).collect()}
    assert len(got) == len(want) and sum(map(len, want.values())) > 10
    for k, spans in want.items():
        r = got[k]
        assert r.base_sha256 == digest(spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == i for x in spans) for i in range(3)]
        assert {x for x in r.spans.split(",") if x and not x.startswith("owned")} == {
            f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans}


def test_edge_texts():
    assert find(None) == [] and find("") == [] and find(" \n") == []
    # a dropped match still consumes its text
    assert [x[:3] for x in find('secret:token="abcdefghijklmnop"')] == []
    assert [x[:3] for x in find("ſecret=abcdefghijklmnop")] == []  # only A-Z letters match in either case
    assert [x[:3] for x in find("é API_KEY = 'abcdefghijkl'")] == [(2, 0, 25)]
    assert [x[1] for x in find("AKIA" + "A" * 13)] == [] and [x[1] for x in find("AKIA" + "A" * 14)] == [1]


def test_ownership_separates_copied_from_owned(spark):
    mine, copied = "Zx9Qw8Er7Ty6Ui5Op4As3Df", "Kj1Hg2Fd3Sa4Po5Iu6Yt7Re"
    rows = [(1, f"a {mine} b", "en", "s1", 0), (2, f"x {copied}", "en", "s2", 0), (3, f"{copied} y", "en", "s3", 0),
            (4, f"{copied}", "en", "s4", 0), (5, None, None, None, None), (6, "", "en", "s1", 0), (6, "", "en", "s1", 0)]
    got = sorted((r.doc_id, r.spans, r.n_live, r.n_shared) for r in secret_report(spark.createDataFrame(rows, COLS)).collect())
    assert got == [(1, "owned:2:25", 1, 0), (2, "", 0, 1), (3, "", 0, 1), (4, "", 0, 1), (5, "", 0, 0), (6, "", 0, 0),
                   (6, "", 0, 0)]
    assert secret_spans(spark.createDataFrame([], COLS)).count() == 0


def test_mask_keeps_rows_and_columns(spark):
    cols = COLS + ", spans string, _rid int, row string"
    t = 'é password = "abcdefghijklmn" and deadbeefdeadbeef0 end'
    rows = [(1, t, "en", "s", len(t), "k", 7, "r"), (None, None, None, None, None, None, None, None),
            (3, "clean", "en", "s", 5, "a", 1, "b"), (3, "clean", "en", "s", 5, "a", 1, "b")]
    out = mask_secrets(spark.createDataFrame(rows, cols))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans", "_rid", "row"]
    got = sorted(map(tuple, out.collect()), key=str)
    masked = 'é [SECRET]" and [SECRET] end'
    assert got == sorted([(1, masked, "en", "s", len(masked), "k", 7, "r"), rows[1], rows[2], rows[3]], key=str)


def test_mask_judges_candidates_by_ownership(spark):
    mine, copied = "Zx9Qw8Er7Ty6Ui5Op4As3Df", "Kj1Hg2Fd3Sa4Po5Iu6Yt7Re"
    rows = [(1, f"a {mine} b", "en", "s1", 0)] + [(k, f"{copied} {k}", "en", f"s{k}", 0) for k in range(2, 6)] + [
        (9, f"{mine} deadbeefdeadbeef {copied}", "en", "s1", 0)]
    got = {r.doc_id: r.text for r in mask_secrets(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {1: "a [SECRET] b", 9: f"[SECRET] [SECRET] {copied}", **{k: f"{copied} {k}" for k in range(2, 6)}}


def test_an_owner_may_repeat_its_secret(spark):
    """Many documents, or many copies of one, under one or two owners are no wide copy; a third owner makes one."""
    often, page, shared = "Zx9Qw8Er7Ty6Ui5Op4As3Df", "Mn3Bv4Cx5Zl6Kj7Hg8Fd9Sa", "Kj1Hg2Fd3Sa4Po5Iu6Yt7Re"
    rows = [(k, f"{often} {k}", "en", "s1", 0) for k in range(30)]
    rows += [(100 + k, f"a {page} b", "en", f"s{k % 2}", 0) for k in range(20)]
    rows += [(200 + k, f"{shared} {k}", "en", f"s{k % 3}", 0) for k in range(20)]
    docs = spark.createDataFrame(rows, COLS)
    got = {r.doc_id: r for r in secret_report(docs).collect()}
    masked = {r.doc_id: r.text for r in mask_secrets(docs).collect()}
    for d, text, *_ in rows:
        live = d < 200
        assert (got[d].n_live, got[d].n_shared) == ((1, 0) if live else (0, 1))
        assert got[d].spans == ("owned:0:23" if d < 100 else "owned:2:25" if live else "")
        assert masked[d] == (text.replace(often, "[SECRET]").replace(page, "[SECRET]") if live else text)
        assert (got[d].most_repos, got[d].most_owners) == ((30, 1) if d < 100 else (2, 2) if live else (20, 3))


def test_without_owners(spark):
    rows = [(1, "a Zx9Qw8Er7Ty6Ui5Op4As3Df b"), (2, "nothing")]
    got = {r.doc_id: (r.spans, r.most_repos, r.most_owners) for r in secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("owned:2:25", 1, 1), 2: ("", 0, 0)}
