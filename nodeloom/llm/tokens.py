"""Token ids of whole texts with a public tokenizer, by words."""

from __future__ import annotations

import re
import struct
import sys
from itertools import chain

import numpy as np


def _kept(kind: str, key: tuple, make):
    """make(), once per process. This module's code comes to workers by value,
    anew with each task, so what they keep hangs on a module that they import.
    Nothing cached by a decorator may stand here: it would be sent by name."""
    held = sys.__dict__.setdefault("_nodeloom_kept", {})
    if (kind, *key) not in held:
        held[kind, *key] = make()
    return held[kind, *key]


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return _kept("tokenizer", (path,), lambda: Tokenizer.from_file(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Texts of ASCII and Latin-1 letters alone; and how the tokenizer cuts them once they are in lower case.
SIMPLE = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
CUT = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
#: Words of ASCII signs (but the apostrophe, which opens contractions) and Latin-1 letters, cut as the tokenizer cuts them.
PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]{1,64}")
PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes, by words (UTF-8).

    The tokenizer drops white space and never joins what it separates, so a
    text's ids are those of its parts between spaces, one after the other. Plain
    words are lowered and cut further, into runs of letters, digits and runs of
    signs. The pieces that are new in a text are tokenized in one call; the last
    id of each is one that ends a word. All other words are tokenized one by
    one. A text of ASCII and Latin-1 letters, without what may open a special
    token, is cut into pieces as a whole. Words and pieces are kept in two generations of at most most each: when
    the young one is full it becomes the old one, from which what is met again
    comes back, so that rare words leave and common ones stay.
    """

    def __init__(self, path: str, plain: bool = False, most: int = 150_000):
        self.tokenizer, self.most, self.plain = _tokenizer(path), most, plain
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        # ASCII letters in lower case pass the normalizer, the cut and the bytes' alphabet as they are, so that the model alone
        # has their ids, unless a special token is made of letters.
        self.alone = not any(re.search("[a-z]", t.content.lower()) and t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.ends = set(np.flatnonzero(self.closes).tolist())

    def _encode(self, text: str) -> np.ndarray:
        self.tokenizer.encode_special_tokens = self.plain
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, words: set[bytes]) -> None:
        cut = {}
        for word in words:
            text = word.decode()
            if PLAIN.fullmatch(text) and "<|" not in text:  # which may open a special token
                cut[word] = PIECE.findall(text.lower())
            else:
                self.words[word] = self._encode(text).tobytes()
        self._learn_pieces(set(chain.from_iterable(cut.values())))
        for word, parts in cut.items():
            self.words[word] = b"".join(map(self.pieces.__getitem__, parts))

    def _learn_pieces(self, met: set[str]) -> None:
        if len(self.pieces) >= self.most:
            self.pieces, self.old_pieces = {}, self.pieces
        new = met.difference(self.pieces)
        again = {x for x in new if x in self.old_pieces}
        self.pieces.update(zip(again, map(self.old_pieces.__getitem__, again)))
        new = list(new - again)
        if self.alone:
            tokenize, ends, rest = self.tokenizer.model.tokenize, self.ends, []
            for piece in new:
                if piece.isascii() and piece.isalpha():
                    ids = [token.id for token in tokenize(piece)]
                    if ids and ids[-1] in ends:
                        self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
                        continue
                rest.append(piece)
            new = rest
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            ids = self._encode(" ".join(some))
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not close each word with an id of its own")
            raw, begin = ids.tobytes(), 0
            for piece, end in zip(some, (4 * ends).tolist(), strict=True):
                self.pieces[piece], begin = raw[begin:end], end

    @classmethod
    def shared(cls, path: str, plain: bool = False) -> "WordIds":
        """The words that this worker process has met so far, in whatever task."""
        return _kept("words", (path, plain), lambda: cls(path, plain))

    def of(self, text: str) -> bytes:
        if "<|" not in text and SIMPLE.fullmatch(text):
            cut = CUT.findall(text.lower())
            met = set(cut)
            self._learn_pieces(met)
            ids = b"".join(map(self.pieces.__getitem__, cut))
            for piece in met:
                if len(piece) > 128:
                    del self.pieces[piece]
            return ids
        words = text.encode("utf-8", "replace").split()
        if len(self.words) >= self.most:
            self.words, self.old_words = {}, self.words
        new = set(words).difference(self.words)
        again = {x for x in new if x in self.old_words}
        self.words.update(zip(again, map(self.old_words.__getitem__, again)))
        new -= again
        if new:
            self._learn(new)
        ids = b"".join(map(self.words.__getitem__, words))
        for word in new:
            if len(word) > 128:
                del self.words[word]
        return ids
