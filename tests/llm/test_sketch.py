"""What near dedup rules out before it compares whole sets is never a pair at the threshold; whole results equal brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from detectframe.llm import near_dedup
from detectframe.llm.common import mix


def _pair(rng, common, own):
    h = mix(rng.integers(1, 2**63, common + 2 * own, dtype=np.uint64))
    return np.unique(h[: common + own]), np.unique(np.concatenate([h[:common], h[common + own :]]))


@pytest.mark.parametrize("common,own", [(4, 0), (8, 1), (16, 2), (80, 10), (800, 100), (8000, 1000)])
def test_pairs_at_the_threshold_stay(common, own):
    rng = np.random.default_rng(common)
    rank = rng.integers(0, 9, near_dedup.RANGES).astype(np.uint8)
    for _ in range(200 if common > 100 else 5000):
        a, b = _pair(rng, common, own)
        x, y = (near_dedup.parity(s).view(np.uint64) for s in (a, b))
        assert near_dedup._near(int(np.bitwise_count(x ^ y).sum()), len(a), len(b), 80)
        assert near_dedup._similar(np.array(len(a)), np.array(len(b)), 80)
        assert np.intersect1d(near_dedup.prefix(a, rank, 80), near_dedup.prefix(b, rank, 80)).size


def _texts(n, seed):
    """Texts that share a passage; every third has a near copy with up to a few changed words, on both sides of 0.8."""
    rng = np.random.default_rng(seed)
    passage, out = [f"p{i}" for i in range(30)], []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 10**7, int(rng.integers(15, 90)))] + passage
        out.append(words)
        if i % 3 == 0:
            copy = list(words)
            for at in rng.integers(0, len(copy), int(rng.integers(1, 5))):
                copy[at] = f"x{rng.integers(0, 10**7)}"
            out.append(copy)
    return [" ".join(w) for w in out]


def _brute(found, percent, k):
    sets = [near_dedup.shingle_set(t.encode(), k) for t in found]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i]) and near_dedup._similar(len(sets[i]), len(sets[j]), percent):
                common = np.intersect1d(sets[i], sets[j]).size
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("block", [8, 512])
def test_large_nodes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    found = _texts(300, block)
    table = spark.createDataFrame(list(enumerate(found)), "key long, text string").repartition(4)
    got = {r.key: r.component for r in near_dedup.near_duplicates(table, 4, 80).collect()}
    want = _brute(found, 80, 4)
    assert [got[i] for i in range(len(found))] == want
    assert len(set(want)) < len(want)


def test_buckets_hold_every_pair(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    found = _texts(150, 5)
    table = spark.createDataFrame(list(enumerate(found)), "key long, text string").repartition(4)
    node = near_dedup._buckets(table, 4, 80)
    met = {(r.a, r.b) for r in node.alias("x").join(node.alias("y"), "node").where("x.key > y.key").select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct().collect()}
    sets = [near_dedup.shingle_set(t.encode(), 4) for t in found]
    for i in range(len(sets)):
        for j in range(i):
            common = np.intersect1d(sets[i], sets[j]).size
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                assert (i, j) in met


@pytest.mark.parametrize("forest", [False, True])
def test_nodes_side_by_side_equal_one_after_another(monkeypatch, forest):
    rng = np.random.default_rng(4)
    nodes, two = [], []
    for _ in range(600):
        base, members = rng.integers(0, 2**63, 16, dtype=np.uint64), []
        for _ in range(int(rng.choice([1, 2, 2, 3, 4, 9, 16, 17, 40]))):
            own = base.copy()
            for bit in rng.integers(0, 1024, int(rng.integers(0, 25))):
                own[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            comp = int(rng.integers(0, 4)) if rng.random() < 0.5 else int(rng.integers(1 << 60))
            members.append({"key": int(rng.integers(1 << 60)), "comp": comp, "n": int(rng.integers(60, 80)), "parity": own.tobytes(), "side": int(rng.integers(2))})
        nodes.append(members)
        two.append(bool(rng.random() < 0.3))
    kind = pa.list_(pa.struct([("key", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("parity", pa.binary()), ("side", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(two)], ["members", "two"])
    found = lambda: sorted(tuple(r.values()) for b in near_dedup._node_pairs(80, forest)(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist())
    together = found()
    monkeypatch.setattr(near_dedup, "FEW", 0)
    apart = found()
    assert len(together) == len(apart) > 500 and (forest or together == apart)
