import random
import zlib
from collections import defaultdict

import pytest

from accessmine.llm import sharding


def by_hand(rows, shards):
    """(size, crc, shard, slot) by (doc_id, text): sizes added up in plain Python."""
    found = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, at, out, used = sum(r[1] for r in found), 0, [], defaultdict(int)
    for i, size, crc in found:
        shard = (2 * at + size) * shards // (2 * total)
        out.append((i, size, crc, shard, used[shard]))
        used[shard] += 1
        at += size
    return sorted(out, key=repr)


@pytest.mark.parametrize("shards", [1, 3, 16, 200])
def test_odd_rows(spark, odd, shards):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    out = sharding.shard_plan(odd, shards).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out), key=repr) == by_hand(rows, shards)
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}


def test_repeated_and_null_ids(spark):
    rows = [(None, "same text") for _ in range(300)] + [(7, "x" * k) for k in range(50)] + [(7, None), (8, ""), (None, "other")]
    out = sharding.shard_plan(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out), key=repr) == by_hand(rows, 4)


def test_balance(spark):
    r = random.Random(4)
    rows = [(i, "y" * r.choice([5, 50, 500, 20_000 if i % 97 == 0 else 7])) for i in range(3000)]
    out = sharding.shard_plan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    bytes_, slots = defaultdict(int), defaultdict(list)
    for x in out:
        bytes_[x.shard] += x.size
        slots[x.shard].append((x.slot, x.doc_id))
    most, share = max(x.size for x in out), sum(bytes_.values()) / 16
    assert len(bytes_) == 16 and all(abs(b - share) <= most for b in bytes_.values())
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in slots.values())
    ranges = sorted((s, min(i for _, i in v), max(i for _, i in v)) for s, v in slots.items())
    assert all(a[2] < b[1] for a, b in zip(ranges, ranges[1:], strict=False))  # contiguous


def test_none(spark, none):
    assert sharding.shard_plan(none).collect() == []
    assert sharding.sharded(none).collect() == []


def test_documents_keep_their_columns(spark, odd, tmp_path):
    out = sharding.sharded(odd, 5)
    assert out.columns == ["shard_", "slot", *odd.columns]  # odd has a column named shard
    plain = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert plain(out.select(*odd.columns).collect()) == plain(odd.collect())
    placed = sorted((x[0], x[1]) for x in out.collect())
    assert len(set(placed)) == len(placed)
    sharding.write_shards(odd.select("doc_id", "text", "lang"), str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count() and {r.shard for r in back.select("shard").distinct().collect()} == {s for s, _ in placed}
    for shard in {s for s, _ in placed}:
        one = [r.slot for r in spark.read.parquet(str(tmp_path / "out" / f"shard={shard}")).collect()]
        assert one == sorted(one)
