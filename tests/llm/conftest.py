"""Small documents with every awkward case: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, rank int, ids string, hash string"


def prose(seed: int, words: int, alphabet: str = "aeioustnrl") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="session")
def prose_text():
    return prose


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text) rows."""
    long = prose(1, 30_000)
    same = prose(2, 120)
    return [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "two words"), (6, same), (7, same), (7, same), (8, same + " more"),
            (9, long), (10, long[:-30]), (None, prose(3, 70)), (None, None), (-5, prose(4, 60)), (11, "é\u0301 ß İ ǅ 漢字 😀 ½ ² ٣\u00a0x\u2003y\x1cz\x85"),
            (12, "\n\n\n" + "line one\n" * 5 + "\n"), (13, "x" * 50_000), (14, "!" * 4000), (15, "don't we'll I'M 's 't  \n\n  'ROUND")]


@pytest.fixture()
def make_docs(spark):
    """A documents table with clashing extra columns."""

    def build(rows, langs=None):
        langs = langs or {}
        full = [(i, t, langs.get(i, "en"), f"src{(i or 0) % 3}", len(t or ""), "k", 1, "i", "h") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build
