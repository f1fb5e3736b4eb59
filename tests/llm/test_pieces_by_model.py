"""Pieces of ASCII letters get their ids from the tokenizer's model alone."""

import numpy as np

from nodeloom.llm.tokens import WordIds, default_path


def test_letters_do_not_go_through_the_whole_tokenizer(monkeypatch):
    words = WordIds(default_path())
    texts = ["Plain thlyouble words, it's 12 o'clock", "Größe ÀÉ x'll " + "ab" * 300, "don't stop-it NOW!! a1b2", "qzxv " * 50]
    want = [np.asarray(words.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    met, encode = [], words._encode
    monkeypatch.setattr(words, "_encode", lambda text: met.extend(text.split()) or encode(text))
    assert [words.of(t) for t in texts] == want
    assert met and not any(x.isascii() and x.isalpha() for x in met)
    slow = WordIds(default_path())
    slow.alone = False
    assert [slow.of(t) for t in texts] == want
