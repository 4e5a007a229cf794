"""The stages one by one against brute force, and the registered SQL."""

import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from compare import compare
from pyspark import SparkContext
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameWriter
from test_jaccard import brute as components
from test_packing import best_fit
from test_quality import brute as facts
from test_spans import PERSONAL, brute as spans
from tokenizers import Tokenizer

import corpus_pipeline
from voxframe.llm.queries import ORACLES, QUERIES
from voxframe.llm.tables import store

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The table before the first stage and after each."""
    tables = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(store(stage(spark, tables[-1], FOLDER), re.sub(r"\W", "-", name)))
    return tables


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_filters_keep_clean_documents(spark, stages):
    before, rules, language = (texts(df) for df in stages[:3])
    assert [df.columns for df in stages[:5]] == [stages[0].columns] * 5
    failed = {i for i, t in before.items() if facts(t)[-1]}
    good = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").collect()}
    assert not failed & set(rules) and good - failed <= set(rules)
    assert len(set(rules) - set(language)) <= 1 and set(language) <= set(rules)


def test_one_document_of_each_group_stays(stages):
    before, after = texts(stages[2]), texts(stages[3])
    groups = components(list(before.items()), 5, 80)
    assert set(after) == {i for i, n, least in groups if n == 0 or i == least}
    assert all(after[i] == before[i] for i in after)


def test_personal_data_is_gone(stages):
    before, after = texts(stages[3]), {r.doc_id: r for r in stages[4].collect()}
    assert set(before) == set(after)
    for i, text in before.items():
        assert spans(after[i].text, PERSONAL)[0] == "" and after[i].n_chars == len(after[i].text)
        if not re.search(r"[0-9@]", text):
            assert after[i].text == text


def test_pieces_fill_few_sequences(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {}
    for r in stages[4].collect():
        n = len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
        lengths.update({(r.doc_id, k): min(2048, n - at) for k, at in enumerate(range(0, n, 2048))})
    got = stages[5].collect()
    assert {(r.doc_id, r.piece): r.length for r in got} == lengths
    assert max(Counter(r.sequence_id for r in got).values()) >= 1
    assert len({r.sequence_id for r in got}) == len(best_fit(lengths.values(), 2048))


@pytest.mark.parametrize("stage", [corpus_pipeline.quality_rules, corpus_pipeline.best_fit_packing])
def test_texts_reach_python_in_small_batches(spark, stage):
    """A batch of 10,000 texts used to be held as a whole, several times over."""
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1200) AS text", "'en' AS lang", "'web' AS source", "6000 AS n_chars")
    stage(spark, docs, FOLDER)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    got = docs.select("doc_id", "text").mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 3000 and max(r.bytes for r in got) <= 5 << 20


def python_on_python(plan, above=False):
    """Does a Python step take the rows of another one in the same task?"""
    python = "InArrow" in plan.nodeName()
    if python and above:
        return True
    above = python or (above and plan.nodeName() not in ("Aggregate", "Join"))
    return any(python_on_python(plan.children().apply(k), above) for k in range(plan.children().size()))


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_a_core_keeps_one_python_worker(spark, stages, stage, monkeypatch):
    """A second Python step in a task, or rows of Python objects, start workers that stay and grow beside the first ones."""
    plans, checkpoint, parquet = [], DataFrame.checkpoint, DataFrameWriter.parquet
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, *a, **b: plans.append(df) or checkpoint(df, *a, **b))
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, *a, **b: plans.append(w._df) or parquet(w, *a, **b))
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: pytest.fail("rows of Python objects"))
    store(corpus_pipeline.STAGES[stage][1](spark, stages[stage], FOLDER), "one-worker")
    assert plans and not any(python_on_python(df._jdf.queryExecution().optimizedPlan()) for df in plans)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_queries_equal_their_sql(spark, name):
    class Query:
        run, sql = staticmethod(QUERIES[name]), ORACLES[name]

    status, _, _, note = compare(spark, FOLDER, name, Query)
    assert status in ("ok", "TYPES"), note
