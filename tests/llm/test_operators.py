"""The training-data operators against plain versions on small tables: NULLs, empty and long texts, ties, repeats, other columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from detectframe.llm import exact_topk, language_id, mixing, near_dedup, packing, paragraph_dedup, quality_classifier, quality_rules, suffix_dedup, url_filters
from detectframe.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, key string, n long"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", ","]) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    passage = " ".join(words(rng, 70))
    base = words(rng, 200)
    for i in range(60):
        w = words(rng, rng.choice([3, 40, 120, 400]))
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = [passage]
        if i % 7 == 0:
            w = list(base)
            for _ in range(i // 14):
                w[rng.randrange(len(w))] = "edit"
        out.append((i, " ".join(w), "en" if i % 2 else "fr", f"s{i % 3}", "k", 1))
    out += [(60, None, None, None, None, None), (61, "", "en", None, None, 0), (62, " \n ", "en", None, None, 0), (63, out[1][1], "en", None, None, 1)]
    out.append((64, "lang " * 9000 + "Ünïcödé " * 30, "fr", "s", "k", 2))
    return out


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_near_dedup_finds_every_component(spark, rows):
    sets = {r[0]: shingles(r[1], 4) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = by_id(near_dedup.near_dedup(spark.createDataFrame(rows, DOCS), 4, 80))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert len({find(i) for i in sets}) < len(sets) - 5


def test_near_dedup_blocks_and_branches(spark, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    docs = spark.createDataFrame(rows, DOCS)
    small = by_id(near_dedup.near_dedup(docs, 4, 80))
    monkeypatch.undo()
    assert small == by_id(near_dedup.near_dedup(docs, 4, 80))


def test_suffix_dedup_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 5000)
    seen, want = set(), {}
    for i, text, *_ in rows:
        data = (text or "").encode()
        mask = bytearray(len(data))
        for j in range(len(data) - 99):
            s = data[j : j + 100]
            if s in seen:
                mask[j : j + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(c for c, m in zip(data, mask) if not m)
        want[i] = (len(data), sum(mask), len(bytes(mask).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest())
    got = by_id(suffix_dedup.repeated_spans(spark.createDataFrame(rows, DOCS)))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 5000


def test_repeated_ids_and_rows_stay_apart(spark, rows):
    docs = spark.createDataFrame([rows[3], rows[3], (None, rows[3][1], *rows[3][2:]), (None, None, None, None, None, None)], DOCS)
    got = suffix_dedup.repeated_spans(docs).collect()
    assert len(got) == 4 and sum(r.n_removed == 0 for r in got if r.n_bytes > 100) == 1
    assert near_dedup.near_dedup(docs).where("kept").count() == 2
    # the row without an id is the first of the three equal ones: both others lose every word
    gone = paragraph_dedup.paragraph_removals(docs).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in gone} == {(3, None)}
    assert all(sum(r.paragraph == q.paragraph for q in gone) == 2 for r in gone)
    left = bytearray(rows[3][1].encode())
    for r in gone:
        left[r.start : r.end] = b" " * (r.end - r.start)
    assert not left.strip()
    assert packing.pack_documents(docs).count() == 4


def test_paragraph_dedup_catches_pasted_passages_only(spark, rows):
    clean = [(100 + i, " ".join(words(random.Random(900 + i), 80, 10**6)), None, None, None, 0) for i in range(10)]
    got = paragraph_dedup.paragraph_removals(spark.createDataFrame(rows + clean, DOCS)).collect()
    touched = {r.doc_id for r in got}
    # document 5 is the first that holds the passage: it stays
    assert {i for i in range(10, 60, 5) if i % 7} <= touched and not touched & set(range(100, 110))
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        a = shingles(texts[r.doc_id][r.start : r.end].decode(), 5)
        assert a and (r.kept_doc_id, r.kept_paragraph) < (r.doc_id, r.paragraph)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = spark.range(0, 600).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionAll(spark.range(1001, 1400).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b")))
    got = {r.key: r.component for r in components(edges).collect()}
    assert len(got) == 601 + 400 and {got[i] for i in range(601)} == {0} and {got[i] for i in range(1000, 1400)} == {1000}


def test_packing_is_gapless_and_tight(spark, rows):
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), capacity=256).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= len(packing.best_fit([r.length for r in got], 256))
    assert {r.doc_id for r in got} == {r[0] for r in rows}


def test_bin_completion_beats_or_equals_best_fit():
    rng = random.Random(5)
    for _ in range(30):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 40))]
        plan = packing.complete(lengths, 100)
        assert sorted(x for s in plan for x in s) == sorted(lengths) and max(map(sum, plan)) <= 100
        assert -(-sum(lengths) // 100) <= len(plan) <= len(packing.best_fit(lengths, 100))


def test_word_ids_equal_whole_text_encoding(rows):
    ids = packing.word_ids(None)
    for text in [r[1] for r in rows if r[1]] + ["J̌ İI x<|STARTOFTEXT|> a\x01b it's \x85 a\xa0b ΣΑΣ"]:
        w = packing.lowered(text.encode()).split()
        ids.learn(set(w))
        assert b"".join(map(ids.young.__getitem__, w)) == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_rules_and_ablation(spark, rows):
    ledger = quality_rules.ledger(spark.createDataFrame(rows, DOCS))
    got = by_id(ledger)
    assert got[60].n_words == 0 and got[60].failed & quality_rules.BIT["few_words"] and got[64].n_repeat_words == 9030
    policy = quality_rules.BASE
    kept = {r.doc_id for r in quality_rules.apply_policy(ledger, policy).where("kept").collect()}
    for r in quality_rules.ablation(ledger, policy).collect():
        bit = quality_rules.BIT[r.rule]
        assert r.n_kept == len(kept) and r.n_failed == sum(bool(x.failed & bit) for x in got.values())
        assert r.n_only == sum(x.failed & policy.mask == bit for x in got.values()) == r.n_kept_without - r.n_kept


def test_url_rules(spark):
    urls = ["http://A.example.com/en/1?x", "http://www.example.com/en/", "ftp://x.net/es/a#b", "no url", None, "http://net/fr/", "http://notexample.com/en/", "http://example.com"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = url_filters.rule_table(spark, [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")])
    got = by_id(url_filters.url_verdicts(pages, rules), "page_id")
    assert [got[i].rule for i in range(8)] == ["example.com/en/", "www.example.com/en/", "net/es/", None, None, "net/fr/", "com/", None]
    assert [got[i].verdict for i in range(8)] == ["block", "allow", "block", "allow", "allow", "block", "allow", "allow"]
    assert url_filters.url_verdicts(pages, rules.limit(0)).where("verdict = 'allow' AND rule IS NULL").count() == 8


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "ROW_BLOCK", 90)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(exact_topk, "STEP", 8)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 8)), 1)
    x[50:80] = x[50]
    data = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)] + [(300, None, 1), (301, [None] * 8, 1), (302, [float("nan")] * 8, 1)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in exact_topk.top_k(exact_topk.quantized(vectors), F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect()]
    v, want = np.floor(64 * x.astype(np.float32).astype(float)).astype(int), []
    for i in range(0, 300, 20):
        best = sorted(((-int(v[i] @ v[j]), j) for j in range(300) if j != i))[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == want


def learning_rows():
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["river", "stone", "house", "green", "walk"]) + rng.choice("aeiou") for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "WIN!!", "idiot"]) + rng.choice("xyz") for _ in range(60))
    foul = lambda: " ".join(rng.choice(["slur", "curse", "insult"]) + rng.choice("xyz") for _ in range(60))
    return [(i, good() if i % 3 else bad() if i % 6 else foul(), "en" if i % 3 else "xx", "s", "k", 1) for i in range(300)], [(i, int(i % 3 > 0), int(i % 6 == 0)) for i in range(300)]


def test_classifiers_learn_and_handle_empty_input(spark):
    rows, marks = learning_rows()
    odd = [(900, None, None, None, None, None), (901, "", None, None, None, None), (902, "12 34", None, None, None, None)]
    docs, labels = spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = by_id(quality_classifier.classify(docs, labels))
    held = [i for i in range(300) if got[i].held_out]
    assert held and np.mean([got[i].predicted == (i % 3 > 0) for i in held]) > 0.97 and 0 <= got[900].score <= 1
    assert {r.score for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    found = by_id(language_id.predict(docs, language_id.fit(docs.where("doc_id % 2 = 0"))))
    assert np.mean([found[i].lang_pred == ("en" if i % 3 else "xx") for i in range(1, 300, 2)]) > 0.97
    assert {found[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert language_id.predict(docs, None).where("lang_pred <> 'und'").count() == 0


def test_mixing_meets_its_targets(spark):
    rows, marks = learning_rows()
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = mixing.mix_to_targets(docs, labels, {"clean": 0.8, "low": 0.15, "toxic": 0.05}).collect()
    total = sum(r.n_tokens for r in got)
    for d, want in {"clean": 0.8, "low": 0.15, "toxic": 0.05}.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) / total - want) < 1e-3
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)


def test_empty_tables(spark, rows):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert near_dedup.near_dedup(none).count() == suffix_dedup.repeated_spans(none).count() == paragraph_dedup.paragraph_removals(none).count() == 0
    assert packing.pack_documents(none).count() == quality_rules.ledger(none).count() == mixing.mix_to_targets(none, labels).count() == 0
    assert quality_classifier.classify(none, labels).count() == language_id.predict(none, language_id.fit(none)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_topk.top_k(exact_topk.quantized(vectors), F.col("vec_id") % 20 == 0).count() == 0
