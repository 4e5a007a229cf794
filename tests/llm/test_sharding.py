import hashlib
from collections import defaultdict

from voxframe.llm import sharding


def test_shards_follow_the_directory(make_docs, awkward, prose_text):
    rows = [*awkward, *((1000 + i, prose_text(i, 10 + i % 40)) for i in range(400))]
    limit = 6000
    got = sharding.assign_shards(make_docs(rows), limit=limit).collect()
    assert len(got) == len(rows)
    size, prefixes = defaultdict(int), defaultdict(int)
    bits = lambda i: bin(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16))[2:].zfill(60)
    for i, t in rows:
        for depth in range(61):
            prefixes[bits(i)[:depth]] += len((t or "").encode())
    for r in got:
        size[r.shard, r.page] += r.bytes
        assert bits(r.doc_id).startswith(r.shard) and len(r.shard) == r.depth
        assert r.depth == 0 or prefixes[r.shard[:-1]] > limit          # only oversized buckets were split
        assert prefixes[r.shard] <= limit or r.bytes > limit or r.page >= 0
    for r in got:
        assert r.shard_bytes == size[r.shard, r.page] and (r.shard_bytes <= limit or r.bytes > limit)


def test_rows_of_one_key_are_paged(make_docs):
    got = sharding.assign_shards(make_docs([(7, "x" * 100)] * 50 + [(8, "y")]), limit=1000).collect()
    assert len(got) == 51 and all(r.shard_bytes <= 1000 for r in got)
    assert len({(r.shard, r.page) for r in got if r.doc_id == 7}) >= 5


def test_one_shard_and_empty_table(make_docs, awkward):
    got = sharding.assign_shards(make_docs(awkward))
    assert {(r.shard, r.page) for r in got.collect()} == {("", 0)}
    assert sharding.assign_shards(make_docs(awkward).limit(0)).count() == 0
