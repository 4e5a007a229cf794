import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from voxframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, capacity):
    """One document at a time: into the tightest bin that has room."""
    left = []
    for length in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(left) if room >= length]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= length
        else:
            left.append(capacity - length)
    return sorted(left)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    runs, bins = packing.plan_bins(dict(Counter(lengths)), 40)
    filled, spans = defaultdict(int), defaultdict(list)
    for r in runs:
        for rank in range(r.from_rank, r.to_rank):
            k, slot = divmod(rank - r.from_rank, r.per_bin)
            filled[r.first_bin + k] += r.length
            spans[r.first_bin + k].append((r.base + slot * r.length, r.length))
    assert sum(r.to_rank - r.from_rank for r in runs) == len(lengths)
    assert sorted(40 - filled[k] for k in range(bins)) == best_fit(lengths, 40)
    for places in spans.values():
        at = 0
        for start, length in sorted(places):
            assert start == at
            at += length


def test_pieces_and_places(make_docs, awkward, prose_text):
    rows = [*awkward, *((100 + i, prose_text(i, 5 + 60 * (i % 9))) for i in range(60)), (300, "The <|endoftext|> it's \x7f A\u030a Σας ΣΑΣ don't... a,'s"), (301, "İX K"), (302, "a<|ENDOFTEXT|> b<|startoftext|>c \n<|endoftext|>"),
            (303, "x\x1cy\x85z\u2003w 's 't\u2028'LL  "), (304, "  lead and trail ")]
    tokenizer = Tokenizer.from_file(PATH)
    expected = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 512)):
            piece = ids[at:at + 512]
            expected.append((i, k, at, len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))))
    got = packing.pack_documents(make_docs(rows), PATH, 512).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) == len(best_fit([e[3] for e in expected], 512))


def test_empty_table(make_docs, awkward):
    assert packing.pack_documents(make_docs(awkward).limit(0), PATH).count() == 0
