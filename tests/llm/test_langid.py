import zlib
from collections import Counter

import numpy as np

from voxframe.llm import langid

ALPHABETS = {"aa": "aeioustnrl", "bb": "uvwxyzkqjo", "cc": "èéàüößmpdc"}


def corpus(prose_text, n=240):
    langs = {i: sorted(ALPHABETS)[i % 3] for i in range(n)}
    return [(i, prose_text(i, 30, ALPHABETS[langs[i]])) for i in range(n)], langs


def test_held_out_accuracy(make_docs, prose_text, awkward):
    rows, langs = corpus(prose_text)
    model = langid.train(make_docs(rows, langs))
    assert model.languages == sorted(ALPHABETS)
    told = {r.doc_id: r for r in langid.identify(make_docs(rows, langs), model).collect()}
    held_out = [i for i in langs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(told[i].lang_pred == langs[i] for i in held_out) / len(held_out) > 0.95
    assert all(0 <= r.score <= 1 for r in told.values()) and sum(told[i].rejected for i in langs) <= 2
    odd = langid.identify(make_docs([*awkward, (70, "123 ½ ²٣ !?"), (71, "漢字漢字 漢字漢字漢字漢字")]), model)
    out = odd.collect()
    assert len(out) == len(awkward) + 2 and odd.columns.count("kept") == 1
    for r in out:
        nothing = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == nothing and (not nothing or (r.score == 0 and r.rejected))
    assert next(r for r in out if r.doc_id == 71).rejected


def test_only_training_rows_teach(make_docs, prose_text):
    rows, langs = corpus(prose_text, 60)
    wrong = {i: ("zz" if zlib.crc32(str(i).encode()) % 5 == 0 else l) for i, l in langs.items()}
    assert "zz" not in langid.train(make_docs(rows, wrong)).languages


def test_nothing_to_learn(make_docs, awkward):
    docs = make_docs(awkward)
    model = langid.train(docs.limit(0))
    assert model.languages == [] and {r.lang_pred for r in langid.identify(docs, model).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_probabilities_sum_to_one():
    """Kneser-Ney probabilities of all next characters, against the plain recursion."""
    words = [("x", w, n) for w, n in (("abab", 3), ("abc", 1), ("ba", 2), ("c", 5), ("cab", 1))]
    model = langid.build(words, ["x"])
    letters = ["a", "b", "c"]
    for prefix in ("", "a", "ab", "cc", "bab"):
        inner = {c: np.exp(step(model, prefix, c)) for c in letters}
        end = np.exp(model.score_words([prefix])[0][0, 0] - (0 if not prefix else chain(model, prefix)))
        assert abs(sum(inner.values()) + end + np.exp(step(model, prefix, "z")) - 1) < 1e-5


def chain(model, word):
    """Log probability of the word without its end."""
    return sum(step(model, word[:k], word[k]) for k in range(len(word)))


def step(model, prefix, char):
    """log p(char | prefix) from differences of whole words."""
    owner, hashes, before = langid.gram_hashes([prefix + char])
    at = len(prefix) + 1
    total = 0.0
    for m in range(langid.ORDER, 0, -1):
        if before[at] < m - 1:
            continue
        row, hit = langid._find(model.grams[m - 1], hashes[m - 1][at:at + 1])
        if hit[0]:
            return total + model.logs[m - 1][row[0], 0]
        if m > 1:
            row, hit = langid._find(model.contexts[m - 2], hashes[m - 2][at - 1:at])
            total += model.backoff[m - 2][row[0], 0] if hit[0] else 0.0
    return total + model.floor[0]


def test_grams_of_all_rows_are_counted(make_docs, monkeypatch):
    """Only about 1,000 documents per language used to be counted, in one table on the driver."""
    monkeypatch.setattr(langid, "WORDS_AT_ONCE", 300)
    spell = lambda n: "".join("abcdefghij"[int(d)] for d in str(n))
    rows = [(i, f"{spell(i)} {spell(i * 7)} {spell(i)}") for i in range(3000)]
    langs = {i: "xy"[i % 2] for i, _ in rows}
    model = langid.train(make_docs(rows, langs), None)
    bags = Counter((langs[i], w) for i, t in rows if zlib.crc32(str(i).encode()) % 5 > 1 for w in t.split())
    whole = langid.build([(l, w, n) for (l, w), n in sorted(bags.items())], ["x", "y"])
    for mine, theirs in ((model.grams, whole.grams), (model.logs, whole.logs), (model.contexts, whole.contexts), (model.backoff, whole.backoff)):
        assert all(np.array_equal(a, b) for a, b in zip(mine, theirs, strict=True))
