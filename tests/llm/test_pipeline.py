"""The pipeline against its stages done by brute force, one after the other."""

import sys

import corpus_pipeline
import pytest

from quarry.llm import langid, rules

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_decontaminate import plain as plain_hits  # noqa: E402
from test_simhash import plain_components, plain_fingerprint  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), "test-stage")
        out.append(docs)
    return out


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_all_but_the_last_keep_the_columns(stages):
    assert all(df.columns == COLUMNS for df in stages[:-1])


def test_each_stage_on_its_own_input(spark, stages):
    start = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    known = rows(stages[0])
    assert set(known) <= set(rows(start)) and len(known) >= 0.99 * start.count()
    good = [r for r in known if rules.passes(rules.Facts(r[1].encode()), rules.RULES)]
    assert rows(stages[1]) == good and len(good) < len(known)
    fps = [plain_fingerprint(t) for _, t in good]
    single = [r for r, c in zip(good, plain_components([i for i, _ in good], fps)) if r[0] == c]
    assert rows(stages[2]) == single and len(single) < len(good)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = [r for r in single if plain_hits([r], items)[0].endswith("False)")]
    assert rows(stages[3]) == clean
    assert sorted(r["doc_id"] for r in stages[4].collect()) == [i for i, _ in clean]


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(str, stages[-1].collect()))


def test_rejected_languages_go(spark):
    docs = spark.createDataFrame([(k, "the cat sat", "en", "s", 1) for k in range(50)] + [(99, "12 34", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = langid.filter_language(docs, langid.train(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(50))
