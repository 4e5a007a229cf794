import hashlib

from pyspark.sql import functions as F

from voxframe.llm import fingerprint


def test_edited_texts_and_likeness(make_docs, prose_text):
    rows = [(i * 7 % 101, prose_text(i, 5 + 9 * i)) for i in range(60)] + [(500, None), (501, ""), (502, "one"), (503, "x" * 9000), (504, "😀é" * 50)]
    order = sorted(rows, key=lambda r: -r[0])
    following = {order[k][0]: order[(k + 1) % len(order)][1] or "" for k in range(len(order))}
    got = {r.doc_id: r for r in fingerprint.fingerprint_digest(make_docs(rows)).collect()}
    assert len(got) == len(rows)
    shingles = lambda t: set(zip(t.split(), t.split()[1:], t.split()[2:]))
    for i, text in rows:
        text, r = text or "", got[i]
        cut = len(text) // 3
        new = text[:len(text) - cut] + following[i][:cut]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        a, b = shingles(text), shingles(new)
        if len(a) > 200:
            assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.15
            assert r.near_next < 0.1


def test_equal_texts_ties_and_nulls(make_docs, awkward):
    got = fingerprint.fingerprint_digest(make_docs(awkward)).collect()
    assert len(got) == len(awkward)
    assert len({r.fingerprint for r in got if r.doc_id in (6, 7)}) == 1
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {""}
    single = fingerprint.fingerprint_digest(make_docs([(1, "a b c d e f")])).collect()[0]
    assert single.near_next == 1.0
    assert fingerprint.fingerprint_digest(make_docs(awkward).limit(0)).count() == 0


def test_sketches_merge(spark, prose_text):
    a, b = prose_text(1, 400), prose_text(2, 400)
    rows = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, c string")
    for c in "abc":
        rows = fingerprint.add_sketch(rows, c, f"s{c}")
    r = rows.select(fingerprint.containment(F.col("sa"), F.col("sc")).alias("inside"), fingerprint.containment(F.col("sc"), F.col("sa")).alias("part"),
                    fingerprint.likeness(fingerprint.merge(F.col("sa"), F.col("sb")), F.col("sc")).alias("whole"), F.size("sa").alias("n")).first()
    assert r.inside == 1.0 and abs(r.part - 0.5) < 0.1 and r.whole > 0.97 and 60 < r.n < 140
