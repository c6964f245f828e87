"""Mixing and sharding: laws, brute force and awkward rows."""
import zlib
from collections import Counter, defaultdict

import pytest

from quire.llm import mixing, sharding

from .helpers import WORDS, awkward, crowded, documents, empty


def targets_reference(sizes, weights=(5, 2, 1)):
    """The resharing as stated: cap what is above, share the excess by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        target = {s: left * weight[s] / w for s in free} | capped
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target
        capped |= {s: 3 * sizes[s] for s in over}


def check_mix(rows, got):
    sizes = Counter()
    for d, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    assert len(got) == len(rows)
    want = targets_reference(sizes)
    taken, largest = Counter(), Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source], rel=1e-12)
        assert x.taken == x.size * x.times and x.taken <= 3 * x.size
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], x.size)
    return want, taken, largest


def test_mix_reaches_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 50)), f"src{i % 11}" if i % 3 else "hot") for i in range(1500)]
    rows += [(2000 + i, "tiny source", "aa") for i in range(3)]
    got = mixing.mix(documents(spark, rows)).collect()
    want, taken, largest = check_mix(rows, got)
    for s in want:      # the nearest threshold: half a document away at most
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, s
    again = {x.doc_id: x.taken for x in mixing.mix(documents(spark, rows[::-1]).repartition(7)).collect()}
    assert again == {x.doc_id: x.taken for x in got}


def test_mix_awkward(spark):
    rows = [(r[0], r[1], r[2]) for r in awkward()]
    df = mixing.mix(crowded(documents(spark, rows)))
    got = df.collect()
    check_mix(rows, got)
    assert "words" in df.columns and all(x.words == "extra words" for x in got)
    assert all(x.taken == 0 for x in got if x.size == 0)
    assert mixing.mix(empty(spark)).count() == 0
    blank = mixing.mix(documents(spark, [(1, None, "a"), (2, "", "b")])).collect()
    assert [(x.size, x.target, x.taken) for x in blank] == [(0, 0.0, 0)] * 2


def check_shards(rows, got, n):
    assert sorted((x.doc_id or -1, x.size, x.text_crc32) for x in got) == sorted(
        (d or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
        assert x.law == "rows" and x.grown_shard is None and 0 <= x.shard < n
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(k, [])) for k in range(n)]
    assert max(counts) - min(counts) <= 1


def test_shards_match_the_mixture(spark):
    rows = [(i, f"text {i % 500}", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(6000)]
    got = sharding.shard(documents(spark, rows)).collect()
    check_shards([(d, t) for d, t, _ in rows], got, 40)
    source = {d: s for d, _, s in rows}
    share = Counter(source.values())
    for k in range(40):
        here = Counter(source[x.doc_id] for x in got if x.shard == k)
        for s, n in share.items():
            assert abs(here[s] - n / 40) <= 2, (k, s)
    again = sharding.shard(documents(spark, rows).repartition(5)).collect()
    assert {x.doc_id: (x.shard, x.slot) for x in again} == {x.doc_id: (x.shard, x.slot) for x in got}


def test_shards_awkward(spark):
    rows = awkward()
    check_shards([(r[0], r[1]) for r in rows], sharding.shard(crowded(documents(spark, rows))).collect(), 40)
    check_shards([(r[0], r[1]) for r in rows], sharding.shard(documents(spark, rows), n_shards=3).collect(), 3)
    assert sharding.shard(empty(spark)).count() == 0
