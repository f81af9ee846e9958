"""MinHash near-dedup as a chosen-path set similarity join.

Documents are sets of word shingles.  Equal sets are one class with one representative.  Each of ``TREES``
independent trees sends a representative to the node of its least shingle under the tree's permutation.  Small
nodes are compared exhaustively; a larger node branches: its members go on to ``BRANCHES`` children chosen by
further minwise tokens (slots of the sketch drawn by the node), until nodes are small.  Members of nodes that do
not thin out (a child keeps more than one in ``CROWDED``) or are still large at ``DEPTH`` meet by prefixes: two sets
that reach the threshold share a token among the first fifth or so of each, in any one order of all tokens.  The
order puts rare tokens first, so a passage that thousands of texts hold does not bring them together.  This loses
no pair.  A bucket of equal prefix tokens that is still large is dealt by set size, then compared in blocks.

A pair is ruled out by the sizes of its sets, or by parities: bit j of a set's ``BITS`` says whether an odd number
of its shingles falls in range j, so two sets differ in at least as many shingles as bits.  Both rule out dissimilar
pairs only.  Every remaining pair is confirmed on the full sets.  Only components are wanted, so a round links
before it compares: first every member of a node with its least member, in large nodes then those outside the main
component with a few of its members (hubs), then a spanning forest of the likeliest pairs between components, then
all pairs that still join different components.  A group of near copies is thus linked by stars, not by all its
pairs, and members of the main component are never compared with each other.

At similarity 0.8 a tree misses a pair with probability about 0.2, ten trees with 1e-7.

NULL and empty texts have no set and are linked with nothing.  Rows that share an id are told apart (see
``keyed``).  Repeated texts are one class.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detectframe.llm.common import WORDS, cut, mix, pick, released, scratch, shingle_hashes, strings, texts
from detectframe.llm.components import components

TREES, BRANCHES, DEPTH = 10, 3, 3
#: Members up to which a node is compared exhaustively, and share of a node in one child at which it does not thin out.
BLOCK, CROWDED = 512, 4
#: Steps that link large nodes to hubs before they are compared, and hubs of a node in each.
STEPS, HUBS = 2, 4
#: Minwise tokens a node may branch by, and parities of a set.
SKETCH, BITS = 128, 1024
#: Ranges of hashes in which shingles are counted to tell rare from frequent ones (a table of fixed size).
RANGES, VECTOR = 1 << 18, 1 << 14
#: Members up to which nodes are compared side by side instead of one after another, and pairs compared in one step.
FEW, AT_ONCE = 16, 1 << 15
_SEEDS = mix(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
_BINS = np.arange(SKETCH, dtype=np.uint64) << np.uint64(57)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    return np.unique(shingle_hashes(WORDS.of(text.lower().split()), k))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Least value in each of ``SKETCH`` ranges; an empty range borrows from the next one that is not."""
    at = np.searchsorted(shingles, _BINS)
    end = np.append(at[1:], len(shingles))
    full = at < end
    where = np.flatnonzero(full)
    lender = where[np.searchsorted(where, np.arange(SKETCH)) % len(where)]
    return (shingles[at[lender]] & np.uint64(0xFFFF)).astype(np.uint16)


def parity(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls in each of ``BITS`` ranges, packed."""
    return np.packbits((np.bincount((shingles >> np.uint64(54)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8))


def prefix(shingles: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of which a set that reaches the threshold with this one has one among its own: rarest ranges first."""
    n = len(shingles)
    order = np.lexsort((shingles, rank[(shingles >> np.uint64(46)).astype(np.int64)]))
    return shingles[order[: n - -(-percent * n // 100) + 1]]


def _features(k: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n", "s0", "s1", "tokens", "sketch", "parity"]
        for b in batches:
            data, at, _ = strings(b.column("text"))
            n, s0, s1, tokens, sketches, parities = [], [], [], [], [], []
            for i in range(b.num_rows):
                h = shingle_set(data[at[i] : at[i + 1]].tobytes(), k)
                n.append(len(h))
                if not len(h):
                    s0.append(0), s1.append(0), tokens.append(None), sketches.append(None), parities.append(None)
                    continue
                s0.append(np.add.reduce(mix(h)).astype(np.int64)), s1.append(np.add.reduce(mix(h ^ _SEEDS[0])).astype(np.int64))
                tokens.append(np.array([mix(h ^ s).min() for s in _SEEDS]).astype(np.int64))
                sketches.append(sketch(h).tobytes())
                parities.append(parity(h).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(n, pa.int64()), pa.array(s0, pa.int64()), pa.array(s1, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(parities, pa.binary())], names
            )

    return run


def _sets(k: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at, _ = strings(b.column("text"))
            for lo in range(0, b.num_rows, 256):
                rows = range(lo, min(lo + 256, b.num_rows))
                found = [shingle_set(data[at[i] : at[i + 1]].tobytes(), k).tobytes() for i in rows]
                yield pa.RecordBatch.from_arrays([b.column("key").slice(lo, len(rows)), pa.array(found, pa.binary())], ["key", "shingles"])

    return run


def _counts(k: int):
    """Shingles of these texts in each range of hashes, as vectors of ``VECTOR`` ranges."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RANGES, np.int64)
        for b in batches:
            data, at, _ = strings(b.column("text"))
            for i in range(b.num_rows):
                np.add.at(total, (shingle_set(data[at[i] : at[i + 1]].tobytes(), k) >> np.uint64(46)).astype(np.int64), 1)
        parts = total.reshape(-1, VECTOR)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["part", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the vectors of each part, as they come."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, counts in zip(b.column("part").to_pylist(), b.column("counts")):
            total[part] = total.get(part, 0) + np.frombuffer(counts.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "counts"])


def _prefixes(k: int, percent: int, rank: np.ndarray):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at, _ = strings(b.column("text"))
            keys = b.column("key").to_numpy()
            for i in range(b.num_rows):
                h = shingle_set(data[at[i] : at[i + 1]].tobytes(), k)
                tokens = prefix(h, rank, percent).astype(np.int64)
                columns = [pa.array(tokens), pa.array(np.full(len(tokens), keys[i])), pa.array(np.full(len(tokens), len(h)))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "key", "n"])

    return run


def _similar(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _near(apart: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in ``apart`` shingles, or more, can reach the threshold."""
    return apart * (100 + percent) <= (100 - percent) * (n + m)


def _parities(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def likely(percent: int):
    """Keeps pairs ``(a, b, na, nb, ka, kb)`` that sizes and parities do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, m = b.column("na").to_numpy(), b.column("nb").to_numpy()
            apart = np.bitwise_count(_parities(b.column("ka")) ^ _parities(b.column("kb"))).sum(axis=1, dtype=np.int64)
            keep = _similar(n, m, percent) & _near(apart, n, m, percent)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def _confirmed(percent: int):
    """Keeps pairs ``(a, b, sa, sb)`` of sorted sets whose similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for sa, sb in zip(b.column("sa"), b.column("sb")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (sa, sb))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _forest(p: np.ndarray, q: np.ndarray, comp: np.ndarray) -> list[int]:
    """Places of pairs (in the given order) that join components not yet joined."""
    names, number = np.unique(comp, return_inverse=True)
    root, left, kept = list(range(len(names))), len(names) - 1, []

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for i, (x, y) in enumerate(zip(number[p].tolist(), number[q].tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(i)
            left -= 1
            if not left:
                break
    return kept


def _few_pairs(starts: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, place, place) of all pairs inside nodes of 2 to ``FEW`` members, at most ``AT_ONCE`` at a time."""
    for m in range(2, FEW + 1):
        nodes = np.flatnonzero(size == m)
        x, y = np.triu_indices(m, 1)
        step = max(1, AT_ONCE // len(x))
        for at in range(0, len(nodes), step):
            now = nodes[at : at + step]
            yield np.repeat(now, len(x)), (starts[now][:, None] + x).ravel(), (starts[now][:, None] + y).ravel()


def _node_pairs(percent: int, forest: bool):
    """Likely pairs between components inside each node row (of two blocks: between the sides)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            lists = batch.column("members")
            starts, flat = lists.offsets.to_numpy(), lists.values
            key, comp, n, side = (flat.field(f).to_numpy() for f in ("key", "comp", "n", "side"))
            bits = _parities(flat.field("parity"))
            two = batch.column("two").to_numpy(zero_copy_only=False)
            few = np.diff(starts) <= FEW
            for node, p, q in _few_pairs(starts, np.diff(starts)):
                ok = (comp[p] != comp[q]) & _similar(n[p], n[q], percent) & (~two[node] | (side[p] != side[q]))
                node, p, q = node[ok], p[ok], q[ok]
                apart = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64)
                ok = _near(apart, n[p], n[q], percent)
                node, p, q, apart = node[ok], p[ok], q[ok], apart[ok]
                if forest and len(p):
                    # components of different nodes are told apart, so one forest serves all nodes
                    best = np.argsort(apart / (n[p] + n[q]), kind="stable")
                    node, p, q = node[best], p[best], q[best]
                    ends = np.rec.fromarrays([np.tile(node, 2), comp[np.concatenate([p, q])]])
                    at = np.arange(len(p))
                    kept = _forest(at, at + len(p), np.unique(ends, return_inverse=True)[1])
                    p, q = p[kept], q[kept]
                out_a.append(key[p])
                out_b.append(key[q])
            for i in np.flatnonzero(~few):
                r = np.arange(starts[i], starts[i + 1])
                # the largest component needs no comparing with itself: the others stand against all
                names, number, size = np.unique(comp[r], return_inverse=True, return_counts=True)
                left = r[number != size.argmax()]
                if not len(left):
                    continue
                apart = np.zeros((len(left), len(r)), np.int64)
                for j in range(bits.shape[1]):
                    apart += np.bitwise_count(bits[left, j][:, None] ^ bits[r, j][None, :])
                nl, nr = n[left][:, None], n[r][None, :]
                ok = (comp[left][:, None] != comp[r][None, :]) & _similar(nl, nr, percent) & _near(apart, nl, nr, percent)
                # a pair of two others appears twice
                ok &= (comp[r] == names[size.argmax()])[None, :] | (key[left][:, None] < key[r][None, :])
                if two[i]:
                    ok &= side[left][:, None] != side[r][None, :]
                p, q = np.nonzero(ok)
                if forest and len(p):
                    best = np.argsort(apart[p, q] / (n[left[p]] + n[r[q]]), kind="stable")
                    p, q = p[best], q[best]
                    kept = _forest(left[p] - starts[i], q, comp[r])
                    p, q = p[kept], q[kept]
                out_a.append(key[left[p]])
                out_b.append(key[r[q]])
            if out_a:
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member of a large node at its ``BRANCHES`` children."""
    for b in batches:
        if not b.num_rows:
            continue
        node = b.column("node").to_numpy().astype(np.uint64)
        sk = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH)
        for j in range(BRANCHES):
            branch = mix(node + np.uint64(j + 1))
            token = sk[np.arange(len(sk)), (branch % np.uint64(SKETCH)).astype(np.int64)]
            child = mix(branch ^ (token.astype(np.uint64) << np.uint64(20)))
            columns = [b.column("node"), pa.array(child.astype(np.int64)), b.column("key"), b.column("comp"), b.column("size")]
            yield pa.RecordBatch.from_arrays(columns, ["node", "child", "key", "comp", "size"])


def _confirm(pairs: DataFrame, corpus: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges among the pairs, checked on full sets."""
    ids = cut(pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct(), "ids")
    sets = cut(pick(corpus.select("key", "text"), ids).mapInArrow(_sets(k), "key long, shingles binary"), "sets")
    both = pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
    return cut(both.select("a", "b", "sa", "sb").mapInArrow(_confirmed(percent), "a long, b long"), "links")


def _sizes_fit(n: str, m: str, percent: int) -> Column:
    """:func:`_similar` as a column, so that pairs go before any sketch travels."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _placed(nodes: DataFrame, comp: DataFrame, *more: str) -> DataFrame:
    """Members of nodes with their components so far."""
    return cut(nodes.select("node", "key", *more).join(comp, "key", "left").select("node", "key", F.coalesce("component", "key").alias("comp"), *more), "placed")


def _open(placed: DataFrame) -> DataFrame:
    """Nodes that hold several components: members, the component with most of them, and how many are outside it."""
    parts = placed.groupBy("node", "comp").agg(F.count("*").alias("c"))
    nodes = parts.groupBy("node").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("most"))
    return nodes.where("most.c < size").select("node", "size", F.col("most.comp").alias("main"), (F.col("size") - F.col("most.c")).alias("rest"))


def _hub_pairs(nodes: DataFrame, comp: DataFrame, step: int, percent: int) -> DataFrame | None:
    """Pairs of each member outside its node's main component with ``HUBS`` members of it, in nodes beyond a block."""
    placed = _placed(nodes, comp, "n")
    full = cut(placed.join(_open(placed).where(F.col("size") > BLOCK), "node"), "large")
    if not full.limit(1).count():
        return None
    least = [F.min(F.struct(F.xxhash64("key", F.lit(HUBS * step + i)).alias("h"), F.struct("key", "n").alias("hub"))).getField("hub") for i in range(HUBS)]
    hubs = full.where("comp = main").groupBy("node").agg(F.array_distinct(F.array(*least)).alias("hubs"))
    fit = F.filter("hubs", lambda hub: 100 * F.least(F.col("n"), hub["n"]) >= percent * F.greatest(F.col("n"), hub["n"]))
    pairs = full.where("comp <> main").select("node", "key", "n").join(hubs, "node").select("key", F.explode(fit).alias("hub"))
    return pairs.select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")).distinct()


def _blocks(flat: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of members to compare.  Beyond one block, the main component meets the others, and these each other, by blocks."""
    other, single = F.col("comp") != F.col("main"), F.col("size") <= BLOCK
    of = lambda n: F.ceil(n / BLOCK).cast("int")
    others, mains = of(F.col("rest")), of(F.col("size") - F.col("rest"))
    own = F.pmod(F.xxhash64("key"), F.when(other, others).otherwise(mains)).cast("int")
    at = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), side.cast("int").alias("side"))
    every = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    among = every(others, lambda o: at(F.least("own", o), F.greatest("own", o), F.col("own") > o))
    against = every(mains, lambda m: at(F.col("own"), -1 - m, F.lit(0)))
    rows = F.when(single, F.array(at(F.lit(0), F.lit(0), F.lit(0)))).when(other, F.concat(against, among)).otherwise(every(others, lambda o: at(o, -1 - F.col("own"), F.lit(1))))
    dealt = flat.withColumn("own", own).select("node", "key", "comp", F.explode(rows).alias("at")).join(known, "key")
    member = F.struct("key", "comp", "n", "parity", F.col("at.side").alias("side"))
    return dealt.groupBy("node", F.col("at.x").alias("x"), F.col("at.y").alias("y")).agg(F.collect_list(member).alias("members")).select("members", (F.col("x") != F.col("y")).alias("two"))


def _ranks(body: DataFrame, k: int) -> np.ndarray:
    """Order of frequency of each range of hashes, as powers of two (``RANGES`` bytes, whatever the table)."""
    schema = "part long, counts binary"
    rank = np.zeros(RANGES, np.uint8)
    for part, counts in body.mapInArrow(_counts(k), schema).repartition(RANGES // VECTOR, "part").mapInArrow(_added, schema).collect():
        rank[part * VECTOR : (part + 1) * VECTOR] = np.ceil(np.log2(np.frombuffer(counts, np.int64) + 1))
    return rank


def _buckets(body: DataFrame, k: int, percent: int) -> DataFrame:
    """``(node, key)`` of texts by their prefix tokens; large buckets are dealt by set size, each set to two classes."""
    rows = cut(body.mapInArrow(_prefixes(k, percent, _ranks(body, k)), "node long, key long, n long"), "prefixes")
    shared = rows.groupBy("node").agg(F.count("*").alias("c")).where("c > 1")
    rows = rows.join(shared, "node")
    # sizes that can reach the threshold lie in equal or neighbouring classes (a little wider than that, for rounding)
    size = F.floor(F.log("n") / float(np.log(100.01 / percent)))
    dealt = rows.where(F.col("c") > BLOCK).select("node", "key", F.explode(F.array(size, size + 1)).alias("class"))
    return rows.where(F.col("c") <= BLOCK).select("node", "key").unionAll(dealt.select(F.xxhash64("node", "class").alias("node"), "key"))


def _leaves(nodes: DataFrame, reps: DataFrame, comp: DataFrame, corpus: DataFrame, k: int, percent: int) -> DataFrame:
    """``(node, key)`` of all nodes to compare that hold several components: small ones, and buckets of the dense ones."""
    level, leaves, dense = _placed(nodes, comp), [], []
    for depth in range(DEPTH + 1):
        full = cut(level.join(_open(level).select("node", "size"), "node"), "level")
        leaves.append(full.where(F.col("size") <= BLOCK).select("node", "key"))
        large = full.where(F.col("size") > BLOCK)
        if not large.limit(1).count():
            break
        if depth == DEPTH:
            dense.append(large.select("key"))
            break
        members = large.join(reps.select("key", "sketch"), "key").select("node", "key", "comp", "size", "sketch")
        children = cut(members.mapInArrow(_children, "node long, child long, key long, comp long, size long"), "children")
        crowded = children.groupBy("node", "child").agg(F.count("*").alias("c"), F.max("size").alias("size")).where(F.col("c") * CROWDED > F.col("size")).select("node").distinct()
        crowded = cut(crowded, "crowded")
        dense.append(large.join(crowded, "node", "left_semi").select("key"))
        level = cut(children.join(crowded, "node", "left_anti").select(F.col("child").alias("node"), "key", "comp").distinct(), "branches")
    if dense:
        keys = cut(reduce(DataFrame.unionAll, dense).distinct(), "dense")
        leaves.append(_buckets(pick(corpus.select("key", "text"), keys), k, percent))
    return cut(reduce(DataFrame.unionAll, leaves), "leaves")


def between(leaves: DataFrame, reps: DataFrame, comp: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Likely pairs between different components; only members of nodes that still hold several take parities along."""
    placed = _placed(leaves, comp)
    full = placed.join(_open(placed), "node")
    pairs = _blocks(full, reps.select("key", "n", "parity")).mapInArrow(_node_pairs(percent, forest), "a long, b long")
    return cut(pairs.distinct(), "pairs")


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after some more links."""
    at = lambda x: comp.select(F.col("key").alias(x), F.col("component").alias(f"c{x}"))
    between = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    roots = components(between)
    moved = comp.join(roots.select(F.col("key").alias("component"), F.col("component").alias("root")), "component", "left")
    return cut(moved.select("key", F.coalesce("root", "component").alias("component")).unionAll(roots.join(comp, "key", "left_anti")), "components")


@scratch
def near_duplicates(corpus: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``key, n_shingles, component`` of every row of ``(key, text)``; the component is its least key."""
    feats = cut(corpus.select("key", "text").mapInArrow(_features(k), "key long, n long, s0 long, s1 long, tokens array<long>, sketch binary, parity binary"), "features")
    classes = cut(feats.where("n > 0").groupBy("n", "s0", "s1").agg(F.min("key").alias("rep")), "classes")
    reps = cut(feats.join(classes.select(F.col("rep").alias("key")), "key", "left_semi"), "reps")
    spread = reps.select("key", "n", F.posexplode("tokens").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "key", "n")
    shared = spread.groupBy("node").agg(F.count("*").alias("c"), F.min(F.struct("key", "n")).alias("leader")).where("c > 1")
    nodes = cut(spread.join(shared.select("node", "leader"), "node"), "nodes")

    side = lambda x: reps.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"k{x}"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        rest = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(likely(percent), "a long, b long")
        return _confirm(cut(rest, "likely"), corpus, k, percent)

    stars = nodes.where(F.col("key") != F.col("leader.key")).where(_sizes_fit("n", "leader.n", percent))
    comp = components(confirmed(stars.select(F.col("leader.key").alias("a"), F.col("key").alias("b")).distinct()))
    for step in range(STEPS):
        pairs = _hub_pairs(nodes, comp, step, percent)
        if pairs is None:
            break
        comp = joined(comp, confirmed(pairs))
    leaves = _leaves(nodes, reps, comp, corpus, k, percent)
    for forest in (True, False):
        pairs = between(leaves, reps, comp, percent, forest)
        if not pairs.limit(1).count():
            break
        more = _confirm(pairs, corpus, k, percent)
        if not more.limit(1).count():
            continue
        comp = joined(comp, more)
    of_class = classes.join(comp.withColumnRenamed("key", "rep"), "rep", "left").select("n", "s0", "s1", F.coalesce("component", "rep").alias("component"))
    out = feats.select("key", "n", "s0", "s1").join(of_class, ["n", "s0", "s1"], "left")
    return out.select("key", F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component"))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document; one document of each component is kept."""
    corpus = texts(docs)
    ids = corpus.select("key", "doc_id")
    found = near_duplicates(corpus, k, percent)
    named = found.join(ids, "key").join(ids.select(F.col("key").alias("component"), F.col("doc_id").alias("component_id")), "component")
    return named.select("doc_id", "n_shingles", "component_id", (F.col("key") == F.col("component")).alias("kept"))
