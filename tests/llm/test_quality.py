import re
from collections import Counter

import numpy as np

from voxframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k:k + 3])] > 1}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), failed


def test_counts_match_brute_force(make_docs, awkward, prose_text):
    rows = [*awkward, (20, "a b c d a b c"), (21, "a a a a"), (22, (prose_text(9, 20) + "\n") * 6), (23, "# * $ % & | < > x")]
    docs = make_docs(rows)
    got = quality.judge(docs, None)
    assert set(docs.columns) <= set(got.columns) and got.columns.count("kept") == 1
    key = lambda r: (str(r[0]), str(r[1]))
    mine = sorted(((r.doc_id, r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()), key=key)
    assert mine == sorted(((i, t, *brute(t)) for i, t in rows), key=key)
    assert all(r.kept == (not r.base_failed) for r in got.collect())


def test_model_separates_labelled_rows(spark, make_docs, prose_text):
    noisy = lambda seed: " ".join(w + random_sign for w, random_sign in zip(prose_text(seed, 90).split(), ["%%%", "###", "&&&"] * 30))
    rows = [(i, prose_text(i, 90) if i % 2 else noisy(i)) for i in range(160)]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(None, 1, 0), (3, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    first, second = quality.train(docs, labels), quality.train(docs, labels)
    assert np.array_equal(first.weights, second.weights)
    judged = {r.doc_id: (r.kept, r.p_low) for r in quality.judge(docs, first).collect()}
    held_out = [judged[i][0] == bool(i % 2) for i in range(100, 160)]
    assert sum(held_out) >= 58
    assert all(0 <= p <= 1 for _, p in judged.values())


def test_too_few_labels_and_empty_tables(spark, make_docs, prose_text):
    docs = make_docs([(1, prose_text(1, 80))])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is None
    assert quality.train(docs.limit(0), labels.limit(0)) is None
    assert quality.judge(docs.limit(0), None).count() == 0


def test_columns_of_the_same_name_in_capitals(make_docs):
    from voxframe.llm import langid

    docs = make_docs([(1, "one two")]).selectExpr("doc_id", "text", "kept as KEPT", "rank as N_Words", "lang as Lang_Pred", "hash")
    assert quality.judge(docs, None).select("kept", "n_words", "hash").first() == (False, 2, "h")
    assert langid.identify(docs, langid.Model([])).select("lang_pred", "KEPT").first() == ("und", "k")


def test_all_labelled_rows_are_learnt_from(spark, make_docs, prose_text, monkeypatch):
    """The pipeline's model used to come from about 3,000 labelled rows on the driver."""
    monkeypatch.setattr(quality, "SHARD", 40)
    noisy = lambda seed: " ".join(w + mark for w, mark in zip(prose_text(seed, 90).split(), ["%%%", "###", "&&&"] * 30))
    rows = [(i, prose_text(i, 90) if i % 2 else noisy(i)) for i in range(300)]
    docs = make_docs([*rows, (7777, None)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(240)] + [(None, 1, 0), (3, None, 0), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    first, second = quality.train_all(docs, labels), quality.train_all(docs.repartition(5), labels)
    assert np.array_equal(first.weights, second.weights) and (first.scale, first.shift) == (second.scale, second.shift)
    judged = {r.doc_id: r.kept for r in quality.judge(docs, first).collect()}
    assert sum(judged[i] == bool(i % 2) for i in range(240, 300)) >= 58
    assert quality.train_all(docs, labels.limit(4)) is None and quality.train_all(docs.limit(0), labels) is None


def test_scale_by_sums_is_that_of_the_rows(spark):
    rng = np.random.default_rng(3)
    margins = rng.normal(size=400)
    low = rng.random(400) < 1 / (1 + np.exp(-3 * margins))
    rows = spark.createDataFrame([(float(m), bool(v)) for m, v in zip(margins, low)], "margin double, low boolean")
    assert np.allclose(quality.fit_scale_of(rows, "margin", "low"), quality.fit_scale(margins, low), atol=1e-8)
    assert quality.fit_scale_of(rows.limit(0), "margin", "low") is None


def test_pipeline_models_use_no_sample(monkeypatch):
    import corpus_pipeline

    calls = []
    monkeypatch.setattr(corpus_pipeline.langid, "train", lambda docs, most: calls.append(most))
    monkeypatch.setattr(corpus_pipeline.langid, "identify", lambda docs, model: docs)

    class Docs:
        columns = ["text"]
        where = select = lambda self, *a: self

    corpus_pipeline.language_id(None, Docs(), "")
    assert calls == [None]
