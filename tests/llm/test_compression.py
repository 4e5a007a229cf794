import zlib

import zstandard

from voxframe.llm import compression


def bad(prose_text, seed):
    return " ".join(w + s for w, s in zip(prose_text(seed, 90).split(), ["%%%", "###", "&&&"] * 30))


def labelled(spark, make_docs, prose_text, n=240):
    docs = make_docs([(i, prose_text(i, 90) if i % 2 else bad(prose_text, i)) for i in range(n)])
    return docs, spark.createDataFrame([(i, i % 2, 0) for i in range(n)] + [(None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark, make_docs, prose_text):
    docs, labels = labelled(spark, make_docs, prose_text)
    model = compression.train(docs, labels)
    assert model == compression.train(docs.repartition(7), labels)
    held = [r for r in compression.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 30 and all(r.predicted == r.doc_id % 2 == (r.score >= compression.GOOD_AT) for r in held)


def test_held_out_labels_teach_nothing(spark, make_docs, prose_text):
    docs, labels = labelled(spark, make_docs, prose_text)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert compression.train(docs, labels) == compression.train(docs, flipped)


def test_scores_equal_sizes_of_whole_texts(spark, make_docs, awkward, prose_text):
    docs, labels = labelled(spark, make_docs, prose_text)
    model = compression.train(docs, labels)
    got = compression.score(make_docs(awkward), model)
    assert got.columns == ["doc_id", "score", "predicted"]

    def size(content, data):
        packer = zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(packer.compress(data[i:i + 1024])) for i in range(0, len(data), 1024))

    wanted = []
    for i, t in awkward:
        data = (t or "").encode()
        wanted.append((i, model.probability((size(model.bad, data) - size(model.good, data)) / (len(data) + 32))))
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.score) for r in got.collect()), key=key) == sorted(wanted, key=key)
    assert all(0 <= s <= 1 for _, s in wanted)


def test_the_end_of_a_long_text_counts(spark, make_docs, prose_text):
    docs, labels = labelled(spark, make_docs, prose_text)
    model = compression.train(docs, labels)
    start = prose_text(500, 3000)
    got = {r.doc_id: r.score for r in compression.score(make_docs([(1, start), (2, start + " " + " ".join(bad(prose_text, s) for s in range(501, 560)))]), model).collect()}
    assert got[2] < got[1]


def test_too_few_labels_and_empty_tables(spark, make_docs, prose_text):
    docs, labels = labelled(spark, make_docs, prose_text, 8)
    assert compression.train(docs, labels) is None
    assert compression.train(docs.limit(0), labels.limit(0)) is None
    assert compression.train(docs, labels.where("quality = 1")) is None
    assert [(r.score, r.predicted) for r in compression.score(docs.limit(1), None).collect()] == [(0.5, 1)]
    assert compression.score(docs.limit(0), None).count() == 0
