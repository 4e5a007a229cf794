import hashlib
import zlib

import duckdb
import pytest

from voxframe.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(levels, at, folded):
    proof = []
    for row in levels[:-1]:
        run = row[at // 2 * 2:at // 2 * 2 + 2]
        proof += [x for k, x in enumerate(run) if k != at % 2]
        folded = H(*[folded if k == at % 2 else x for k, x in enumerate(run)])
        at //= 2
    return folded, proof


def grow(row):
    levels = [row]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r, more=0: H(part(r[0]), part(r[1]), part(r[2]), part(None if r[3] is None else r[3] + more), part(r[4]))
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = grow([leaf(r) for r in by_lang[lang]])
    upper = grow([trees[lang][-1][0] for lang in langs])
    root, out = upper[-1][0], []
    for place, lang in enumerate(langs):
        for at, r in enumerate(by_lang[lang]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded, proof = climb(trees[lang], at, leaf(r, 1) if tampered else leaf(r))
            folded, more = climb(upper, place, folded)
            out.append((r[0], leaf(r), trees[lang][-1][0], root, H(*proof, *more), folded, folded == root))
    return sorted(out, key=str)


def build(spark, rows):
    return spark.createDataFrame([(*r, "extra", 7) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int")


MANY = [(i, f"src{i % 3}", None if i % 13 == 0 else ["en", "de", "fr", "Ä", "z"][min(i % 7, 4)], None if i % 11 == 0 else i, f"text {i}") for i in range(700)]
ODD = [(None, None, None, None, None), (None, None, None, None, None), (5, "", "", 0, ""), (5, "", "", 0, ""), (5, "x", "en", 3, "é😀"), (-7, "s", "en", 1, "y" * 300_000),
       (2**62, "s", "only", 9, "lone"), (5, "x", "en", 4, "same id")]


@pytest.mark.parametrize(("stride", "pages"), [(merkle.STRIDE, merkle.PAGE_BITS), (2, 1), (1, 3)])
def test_manifest_equals_brute_force(spark, monkeypatch, stride, pages):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    monkeypatch.setattr(merkle, "PAGE_BITS", pages)
    rows = (MANY if stride > 1 else MANY[:90]) + ODD
    got = [tuple(r) for r in merkle.manifest(build(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert any(r[6] for r in got) and not all(r[6] for r in got)


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STRIDE", 3)
    rows = [(i, "s", f"lang{i % 40}", i, "t") for i in range(110)]
    assert sorted((tuple(r) for r in merkle.manifest(build(spark, rows)).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[(1, "s", "en", 2, "t")], [(8, "s", "en", 2, "t"), (9, "s", None, 2, "t")], [(1, "s", "en", 2, "t"), (2, "s", "en", 2, "t")]])
def test_smallest_tables(spark, rows):
    assert sorted((tuple(r) for r in merkle.manifest(build(spark, rows)).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    got = merkle.manifest(build(spark, MANY[:1]).limit(0))
    assert got.count() == 0 and got.columns == merkle.manifest(build(spark, MANY[:1])).columns


def test_recursion_limit_is_put_back(spark):
    before = spark.conf.get(merkle.ROW_LIMIT)
    merkle.manifest(build(spark, MANY[:5]))
    assert spark.conf.get(merkle.ROW_LIMIT) == before


def test_sql_agrees(spark):
    documents = build(spark, MANY + ODD).toArrow()  # noqa: F841
    assert sorted(duckdb.sql(merkle.manifest_sql()).fetchall(), key=str) == brute(MANY + ODD)
