"""License scan against plain search and a recursive parser: NULLs, empty and long texts, covering phrases, broken expressions."""

import itertools
import random
import re

import pytest

from detectframe.llm import license_scan as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def plain_base(text):
    words = words_of(text)
    found = [(i, label) for phrase, label in L.BASE.items() for i in places(words, phrase)]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def plain_notices(text):
    words = words_of(text)
    spans = [(i, i + len(p.split()), p) for p in L.NOTICES for i in places(words, p)]
    out, reach = set(), 0
    for _, end, p in sorted(spans, key=lambda s: (s[0], -s[1])):
        if end > reach:
            out.add(L.NOTICES[p][0])
            reach = end
    return out


PARTS = ["mit", "MIT License", "Apache", "license", "GNU", "Lesser", "General-Public", "general public license", "BSD", "2", "clause", "CC", "BY", "NC", "creative commons",
         "attribution", "sharealike", "é", "x", "K", "All Rights Reserved", "0"]


def texts():
    rng = random.Random(2)
    out = ["".join(rng.choice(PARTS) + rng.choice([" ", "-", "\n", ", ", "_", " "]) for _ in range(rng.randrange(40))) for _ in range(400)]
    return [None, "", "\x00\x7f", "mit licenses", "amit license", "MIT LICENSE", "mit\x7flicense", "x " * 200000 + "MIT license " * 3, *out]


def test_words_phrases_and_places_equal_plain_search():
    for text in texts():
        got = L.judge(text)
        assert got[:5] == plain_base(text)
        assert set(got[5].split(",")) - {""} == set(got[4].split(",")) - {""} | plain_notices(text)
        assert 0 <= got[6] <= 1 and (got[6] > 0) == bool(got[5])


def parse(tokens):
    """Recursive descent: OR of AND of WITH of atoms; labels and obligation."""

    def atom():
        t = tokens.pop(0)
        if t != "(":
            label, rank = L.family(t)
            return {label}, rank
        inner = level(0)
        assert tokens.pop(0) == ")"
        return inner

    def level(k):
        if k == 2:
            left = atom()
            while tokens and tokens[0] == "with":
                tokens.pop(0)
                atom()
                left = left[0], max(left[1] - 1, 0)
            return left
        left, word, fold = level(k + 1), ("or", "and")[k], (min, max)[k]
        while tokens and tokens[0] == word:
            tokens.pop(0)
            right = level(k + 1)
            left = left[0] | right[0], fold(left[1], right[1])
        return left

    return level(0)


def expression(rng, depth):
    if not depth or rng.random() < 0.3:
        one = rng.choice(["MIT", "Apache-2.0", "GPL-2.0-only", "LGPL-2.1+", "CC-BY-NC-4.0", "LicenseRef-own", "ISC"])
        return one + (" WITH Classpath-exception-2.0" if rng.random() < 0.2 else "")
    inner = f"{expression(rng, depth - 1)} {rng.choice(['AND', 'OR', 'and'])} {expression(rng, depth - 1)}"
    return f"( {inner} )" if rng.random() < 0.5 else inner


def test_expressions_equal_a_recursive_parser():
    rng = random.Random(4)
    for _ in range(500):
        text = expression(rng, 4)
        order, whole = L.postfix(L.tokens(text.lower()))
        assert whole and L.evaluate(order) == parse(text.lower().split())


@pytest.mark.parametrize("text, labels, obligation", [
    ("// SPDX-License-Identifier: MIT OR GPL-2.0-only */", "gpl,mit", "permissive"),
    ("License-Expression: MIT AND GPL-2.0-only", "gpl,mit", "strong copyleft"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "gpl", "weak copyleft"),
    ("SPDX-License-Identifier: MIT is what we chose", "mit", "permissive"),
    ("SPDX-License-Identifier: (MIT OR ISC", "isc,mit", None),
    ("SPDX-License-Identifier: ISC)", "isc", "permissive"),
    ("SPDX-License-Identifier: AND OR )(", "", None),
    ("SPDX-License-Identifier:\nMIT", "", None),
    ("SPDX-License-Identifier: ISC\nspdx-license-identifier: MPL-2.0", "isc,mpl", "weak copyleft"),
    ("SPDX-License-Identifier: " + "(" * 5000 + "MIT" + ")" * 5000, "mit", "permissive"),
])
def test_tags(text, labels, obligation):
    got = L.judge(text)
    assert got[5] == labels and got[8] == obligation


def test_every_order_of_tokens_is_read_without_a_crash():
    for n in range(5):
        for found in itertools.product(["mit", "(", ")", "and", "or", "with"], repeat=n):
            order, whole = L.postfix(iter(found))
            assert L.evaluate(order) is not None or not any(t == "mit" for t in order)
            assert not whole or order


def test_scan_keeps_every_row(spark):
    rows = [(i, t, 5, "x") for i, t in enumerate(texts()[:60])] + [(None, "MIT License", None, None), (3, "MIT License", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, labels string")
    got = sorted((tuple(r) for r in L.scan(docs).collect()), key=str)
    want = sorted(((r[0], *L.judge(r[1])) for r in rows), key=str)
    assert [g[:9] for g in got] == [w[:9] for w in want]
    assert L.scan(docs.where("false")).count() == 0
