"""Histogram sort against its law."""

import zlib

import pytest

from recoflux.llm import sharding as S

TEXT = "doc_id long, text string"


def shards(df, **k):
    rows = S.shard_by_bytes(df, **k).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return rows, by


def test_sizes_are_near_equal_and_groups_stay_together(spark):
    texts = [f"{i} " + "é" * (i * 37 % 200) for i in range(1500)] + ["one group " * 3] * 40 + [None, ""]
    rows, by = shards(spark.createDataFrame(list(enumerate(texts)), TEXT))
    sizes = [len((t or "").encode()) + 8 for t in texts]
    got = sorted((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows)
    assert got == [(i, s, zlib.crc32((t or "").encode()), "bytes", None) for i, (t, s) in enumerate(zip(texts, sizes, strict=True))]
    share = sum(sizes) / 24
    assert set(by) == set(range(24)) and all(abs(sum(r.size for r in p) - share) < max(sizes) + 0.04 * share for p in by.values())
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"one group " * 3)}) == 1


def test_a_hot_group_is_split_by_id(spark):
    rows, by = shards(spark.createDataFrame([(i, "same text") for i in range(4000)], TEXT))
    assert {len(p) for p in by.values()} <= set(range(155, 180)) and len(by) == 24


@pytest.mark.parametrize("data", [[], [(1, "a")], [(None, None), (None, "x"), (1, "x"), (1, "x")]])
def test_odd_tables(spark, data):
    rows, _ = shards(spark.createDataFrame([(*x, 7, "s") for x in data], TEXT + ", size int, h string"))
    assert len(rows) == len(data)
