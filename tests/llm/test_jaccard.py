import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.llm import jaccard


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[a:a + width]) for a in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, width, percent):
    """(n, smallest id of the component) of every row; -1 where a component has no id."""
    sets, parent = [shingles(t, width) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in enumerate(sets):
        for b in range(a):
            both = len(s & sets[b])
            if both and 100 * both >= percent * (len(s) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted((-1 if i is None else i, len(sets[a]), least.get(find(a), -1)) for a, (i, _) in enumerate(rows))


def edited(text, rng, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = "w" + str(rng.randrange(10**6))
    return " ".join(words)


@pytest.fixture()
def corpus(awkward, prose_text):
    """A large group of copies of growing distance, passages that many texts share, and all awkward rows."""
    rng, rows = random.Random(5), list(awkward)
    base, passage = prose_text(50, 150), prose_text(51, 60)
    rows += [(100 + i, edited(base, rng, i // 6)) for i in range(60)]
    rows += [(300 + i, prose_text(400 + i, 40) + " " + passage + " " + prose_text(600 + i, 30)) for i in range(25)]
    rows += [(500 + i, passage.upper() if i % 2 else passage) for i in range(4)]
    rows += [(600 + i, edited(passage, rng, 1)) for i in range(12)]
    return rows


@pytest.mark.parametrize("width, percent, frequent", [(3, 90, 32), (3, 90, 3), (5, 80, 2), (2, 60, 4)])
def test_components_match_brute_force(make_docs, corpus, width, percent, frequent):
    got = jaccard.jaccard_components(make_docs(corpus), width, percent, frequent).collect()
    fill = lambda x: -1 if x is None else x
    assert sorted((fill(r.doc_id), r.n_shingles, fill(r.component_id)) for r in got) == brute(corpus, width, percent)


def test_one_row_of_each_component_stays(make_docs, corpus):
    docs = make_docs(corpus)
    left = jaccard.one_per_component(docs, 5, 80)
    assert left.columns == docs.columns
    kept = sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect())
    groups = brute(corpus, 5, 80)
    expected = sorted(i for i, n, c in set(groups) if n == 0 or i == c)
    assert kept == expected


def test_empty_table(make_docs, awkward):
    assert jaccard.jaccard_components(make_docs(awkward).limit(0)).count() == 0


def test_combinations_meet_whenever_sets_may_link():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for n in (9, 20, 57, 130, 400):
            for _ in range(20):
                a = np.unique(rng.integers(-2**63, 2**63 - 1, n))
                drop = rng.integers(0, jaccard.allowed_misses(n, percent) + 1)
                b = np.sort(np.concatenate((rng.permutation(a)[drop:], rng.integers(-2**63, 2**63 - 1, rng.integers(0, n // 5 + 1)))))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    assert len(np.intersect1d(jaccard.cell_signatures(a, percent), jaccard.cell_signatures(b, percent)))
                words = jaccard.bitmap_words(n, percent)
                apart = sum(bin(int(x) & (2**64 - 1)).count("1") for x in jaccard.bitmap(a, words) ^ jaccard.bitmap(b, words))
                assert apart <= len(a) + len(b) - 2 * both


def test_places_of_rare_tokens_look_at_each_entry_once(spark):
    """For every token all entries of its window were searched again: the square of the length of a text."""
    rng = np.random.default_rng(4)
    rows = [(n, [(int(p), int(rng.integers(99)), bool(rng.random() < 0.4)) for p in sorted(rng.choice(40, n % 20, replace=False))]) for n in range(60)]
    df = spark.createDataFrame(rows, "n long, entries array<struct<pos:int,token:long,often:boolean>>")
    out = df.select("n", jaccard.rare_places(F.col("entries")).alias("x"))
    assert out._jdf.queryExecution().analyzed().toString().split("LogicalRDD")[0].count("entries#") == 1
    for r in out.collect():
        held = rows[r.n][1]
        assert [tuple(x) for x in r.x] == [(token, pos - sum(o for p, _, o in held if p < pos)) for pos, token, often in held if not often]


def test_shingles_keep_no_words_between_texts():
    """Most words of a large corpus are new; keeping them took more time than hashing them, and memory in every worker."""
    import xxhash

    words = [b"a", b"bb", b"a", b"bb", b"a", b"c" * 40]
    expected = set()
    for low in range(len(words) - 1):
        out = np.full(1, 2, np.uint64)
        for word in words[low:low + 2]:
            out = jaccard.mix(out * np.uint64(0x9E3779B97F4A7C15) + np.uint64(xxhash.xxh64_intdigest(word)))
        expected.add(int(out.view(np.int64)[0]))
    before = {name: len(x) for name, x in vars(jaccard).items() if isinstance(x, dict)}
    assert jaccard.shingle_hashes(" ".join(w.decode() for w in words).upper(), 2).tolist() == sorted(expected)
    assert jaccard.shingle_hashes("one", 3).size == 1 and jaccard.shingle_hashes(" ", 3).size == jaccard.shingle_hashes(None, 3).size == 0
    assert before == {name: len(x) for name, x in vars(jaccard).items() if isinstance(x, dict)}
