import re
import subprocess
import sys
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from kilonova.llm import near_dup
from kilonova.llm.common import written
from tests.llm.test_near_dup import brute as brute_near
from tests.llm.test_quality_rules import brute as brute_quality
from tests.llm.test_secret_scan import brute as brute_secrets

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(written(f(spark, out[-1], SF), f"test-{name}"))
    return out


def test_shapes(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dedup", "secret_scan", "packing"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_decisions_against_brute_force(spark, stages):
    rows = [{r.doc_id: r for r in df.collect()} for df in stages[:-1]]
    assert all(rows[i + 1].keys() <= rows[i].keys() for i in range(3)) and rows[3].keys() == rows[4].keys()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    # toxicity: clean labelled rows stay
    clean = [d for d, x in labels.items() if x.toxic == 0 and d in rows[0]]
    assert sum(d in rows[1] for d in clean) >= 0.98 * len(clean)
    # quality: whoever fails the base rule goes; good labelled rows that pass it stay
    failed = {d for d, r in rows[1].items() if brute_quality(r.text)[-1]}
    assert not failed & rows[2].keys()
    good = [d for d, x in labels.items() if x.quality == 1 and d in rows[1] and d not in failed]
    assert sum(d in rows[2] for d in good) >= 0.98 * len(good)
    # near duplicates: exactly one row of each component, the one that names it
    comp = brute_near([(d, r.text) for d, r in rows[2].items()])
    assert {c for _, _, c in comp} == set(rows[3])
    assert all(rows[3][d] == rows[2][d] for d in rows[3])
    # secrets: masked where the base patterns match, all else untouched
    for d, r in rows[3].items():
        if brute_secrets(r.text):
            assert "[SECRET]" in rows[4][d].text and not brute_secrets(rows[4][d].text)
        assert rows[4][d].n_chars == len(rows[4][d].text) or rows[4][d] == r
    # packing: every token of every text
    got = Counter()
    for r in stages[-1].collect():
        got[r.doc_id] += r.n_tokens
    assert got == {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) + 1 for d, r in rows[4].items()}


def test_run_returns_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.select("doc_id", "piece", "n_tokens").collect())) == sorted(
        map(str, stages[-1].select("doc_id", "piece", "n_tokens").collect()))


def test_odd_rows_and_clashing_columns(spark):
    cols = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, kept string, bin_id int"
    words = " ".join(f"word{i}" for i in range(30))
    rows = [(1, words, "en", "s", len(words), "r", 1.0, "k", 1), (2, words, "en", "s", len(words), "r", 1.0, "k", 1), (1, words, "en", "s", len(words), "r", 1.0, "k", 1),
            (3, None, None, None, None, None, None, None, None), (4, "", "en", "s", 0, "r", 1.0, "k", 1), (None, words + " x y z", "en", "s", 0, "r", 1.0, "k", 1)]
    docs = spark.createDataFrame(rows, cols)
    for df in (docs, docs.limit(0)):
        for name, f in corpus_pipeline.STAGES[:-1]:
            df = written(f(spark, df, SF), f"odd-{name}")
            assert df.dtypes == docs.dtypes
        last = corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()
        assert sorted((r.doc_id or 0, r.n_tokens) for r in last) in ([(0, 34), (1, 31)], [])


def test_library_works_without_the_corpus_part(tmp_path):
    """The entry module imports, with all other queries, where the corpus folders are gone."""
    code = ("import sys, importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path, target=None):\n"
            "        if name.startswith('kilonova.llm') or name == 'corpus_pipeline':\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "q = e.queries()\n"
            "assert 'basic_ts' in q and not [n for n in q if n.startswith('op')] and 'pipeline' not in q\n")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
