import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st

from voxframe.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_ids_and_round_trip(make_docs, awkward):
    texts = [*awkward, (40, "<|endoftext|> stays text"), (41, "a  b   c\n\n d"), (42, "\u2028 \ufeff x")]
    for block in (50, 1 << 20):     # many small blocks, and one
        encoded = bpe.encode(make_docs(texts), RANKS, public_tokenizers.PATTERN, block)
        got = bpe.decode(encoded, RANKS).collect()
        key = lambda r: (str(r[0]), r[1], r[2])
        mine = sorted(((r.doc_id, bytes(r.decoded), np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=key)
        assert mine == sorted(((i, (t or "").encode(), OWN.encode_ordinary(t or "")) for i, t in texts), key=key)
        assert all(r.n_tokens * 4 == len(r.ids) for r in got)
        both = bpe.encode(make_docs(texts), RANKS, public_tokenizers.PATTERN, block, decoded="decoded").collect()
        assert sorted(((r.doc_id, bytes(r.decoded), np.frombuffer(r.ids, "<u4").tolist()) for r in both), key=key) == mine


def test_empty_table(make_docs, awkward):
    encoded = bpe.encode(make_docs(awkward).limit(0), RANKS, public_tokenizers.PATTERN)
    assert bpe.decode(encoded, RANKS).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_pretokens_are_those_of_the_library(text):
    import regex

    text = text.encode("utf-8", "ignore").decode()
    words = regex.findall(bpe.pretoken_pattern(public_tokenizers.PATTERN), text)
    assert [i for w in words for i in OWN._encode_single_piece(w.encode())] == OWN.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**33)), st.lists(st.binary(max_size=9)))
def test_packed_numbers_and_strings(numbers, strings):
    packed = bpe.pack_numbers(np.array(numbers, np.int64))[0]
    assert bpe.unpack_numbers(packed).tolist() == bpe.unpack_numbers(packed, step=7).tolist() == numbers
    assert bpe.unpack_strings(bpe.pack_strings(strings)) == strings
