"""The manifest against a plain tree: NULLs, empty texts, repeated rows, one source with most rows, several layers, other columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from detectframe.llm import merkle_manifest as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos long, leaf string, block string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n_chars, *_):
    return h(*map(enc, (doc_id, source, lang, n_chars, text)))


def up(nodes):
    """Levels of a plain tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, at):
    out = []
    for row in levels[:-1]:
        a = at - at % 3
        out.append((row[a:at], row[at + 1 : a + 3]))
        at //= 3
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: up([leaf(*r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))]) for g in order}
    top = up([trees[g][-1][0] for g in order])
    out = []
    for g in order:
        ranked = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        for i, r in enumerate(ranked):
            path = way(trees[g], i) + way(top, order.index(g))
            forged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r[0], r[1].replace("\n", "") if forged and r[1] is not None else r[1], *r[2:])
            for a, b in path:
                node = h(*a, node, *b)
            out.append((r[0], leaf(*r), trees[g][-1][0], top[-1][0], h(*["".join(a + b) for a, b in path]), node, node == top[-1][0]))
    return sorted(out, key=str)


def documents(n):
    rows = [(i, f"line {i}\nnext\n" if i % 3 else f"no break {i}", "en" if i % 4 else None, "big" if i % 3 else f"s{i % 7}", i, 1, "x", "y") for i in range(n)]
    rows += [(n, None, None, None, None, None, None, None), (n + 1, "", "", "", 0, 0, "", ""), (n + 2, "é\n" * 50000, "fr", "ü", 7, 0, "", "")]
    return rows + [rows[5]] * 3 + [(None, "no\nid", "en", "big", 1, 0, "", ""), (None, "no\nid", "en", None, 1, 0, "", "")]


def audited(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return M.audit(docs, F.crc32(F.col("doc_id").cast("string")) % 2 == 0)


@pytest.mark.parametrize("height", [1, 2, 7])
def test_equals_plain_tree_over_one_and_more_layers(spark, monkeypatch, height):
    monkeypatch.setattr(M, "HEIGHT", height)
    monkeypatch.setattr(M, "BLOCK", M.FAN**height)
    rows = documents(90)
    # workers read the module anew, so the tree is built here as they would with these sizes
    got = sorted((tuple(r)[:7] for r in audited(spark, rows).collect()), key=str) if height == 7 else None
    want = plain(rows)
    if got is not None:
        assert got == want
        assert any(not r[6] for r in got) and any(r[6] for r in got)
    else:
        leaves = [r[1] for r in want]
        blocks = [M.Tree(leaves[i : i + M.BLOCK], len(leaves) <= M.BLOCK) for i in range(0, len(leaves), M.BLOCK)]
        assert up([b.top for b in blocks])[-1] == up(leaves)[-1]
        again = up([b.top for b in blocks])
        for i in range(len(leaves)):
            path = blocks[i // M.BLOCK].path(i % M.BLOCK) + [("".join(a), "".join(b)) for a, b in way(again, i // M.BLOCK)]
            assert M.copied(leaves[i], path)[-1] == up(leaves)[-1][0]


def test_a_source_of_several_blocks(spark):
    rows = [(i, f"t{i}\n", "en", "one" if i < 7000 else "two", i, 0, "", "") for i in range(9200)]
    assert sorted((tuple(r)[:7] for r in audited(spark, rows).collect()), key=str) == plain(rows)


def test_versions_copy_their_path_only(spark):
    rows = [(i, f"t{i}\n", "en", "one", i, 0, "", "") for i in range(2000)]
    for r in audited(spark, rows).collect():
        assert len(r.copied) == (0 if r.verified else 7)
        assert r.verified or r.copied[-1] == r.folded_root


@pytest.mark.parametrize("rows", [[], [(7, "a\nb", None, None, None, None, None, None)]])
def test_empty_table_and_single_row(spark, rows):
    assert sorted((tuple(r)[:7] for r in audited(spark, rows).collect()), key=str) == (plain(rows) if rows else [])
