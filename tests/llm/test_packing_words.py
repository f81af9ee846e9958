"""Ids of words that go straight to the tokenizer's model equal those of the whole tokenizer."""

import json
import random

import numpy as np

from detectframe.llm import packing

PLAIN = [c for c in map(chr, range(0x21, 0x2100)) if not packing._ODD.search(c)]


def encoded(ids, text):
    return np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def by_word(ids, text):
    w = packing.lowered(text.encode()).split()
    ids.learn(set(w))
    return b"".join(map(ids.young.__getitem__, w))


def texts():
    rng = random.Random(11)
    yield " ".join(f"{c} a{c}b {c}{c} 7{c}7 .{c}. '{c}" for c in PLAIN)
    yield "it's IT'S o'reilly's 'll''ll don't've ''s x's9 '' 's 'RE l'École ÜBER ÄÖÜß “Ça” — 3.14e10 a_b c|d <b> < | <a|b> x<y"
    for _ in range(40):
        yield " ".join("".join(rng.choices(PLAIN, k=rng.randrange(1, 12))) for _ in range(100))


def loaded(path=None):
    packing._LOADED.clear()
    return packing.word_ids(path)


def test_plain_words_equal_the_whole_tokenizer():
    ids = loaded()
    assert len(PLAIN) == 94 + 62 + 24
    for text in texts():
        assert by_word(ids, text) == encoded(ids, text)


class Model:
    """A tokenizer that may not be called as a whole."""

    def encode(self, *_, **__):
        raise AssertionError("a plain word went through the whole tokenizer")


def test_plain_words_go_to_the_model_alone():
    ids = loaded()
    want = [encoded(ids, t) for t in texts()]
    ids.tokenizer = Model()
    assert [by_word(ids, t) for t in texts()] == want
    packing._LOADED.clear()


def test_odd_words_among_plain_ones():
    ids = loaded()
    text = "plain Ünï été J̌ İI x<|STARTOFTEXT|> <|endoftext|>y a\x01b \x01 it's a\xa0b ΣΑΣ жук 漢字 ²ª ×÷ \U0001f600 a\x85b \x7f\x1f end,"
    assert by_word(ids, text) == encoded(ids, text)


def test_other_tokenizers_are_used_whole(tmp_path):
    import public_tokenizers

    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    spec["normalizer"] = {"type": "Sequence", "normalizers": [*spec["normalizer"]["normalizers"], {"type": "Replace", "pattern": {"String": "z"}, "content": "s"}]}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    ids = loaded(str(path))
    text = "zebra Zoo's plain words, a fuzz"
    assert not ids.plain and by_word(ids, text) == encoded(ids, text) != encoded(loaded(), text)
