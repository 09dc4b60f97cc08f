"""Encoding with the tokenizers library, one distinct word at a time.

A byte-level tokenizer cuts a text before every space that is followed by a character other than white space, whatever
stands around it, so the ids of a text are those of its space-led words one after another. The library encodes each
distinct word once per batch; the words met first are kept for later batches. Plain words, whose only space is the one
they begin with, go to the library many in one string: the strings' ids are cut again before each id that begins with a
space. Texts that hold one of the tokenizer's added tokens are left to the library whole.
"""
from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np

#: A space between two white-space characters: there a word does not begin at each space. Python's class of white space
#: holds every character of the tokenizer's class.
INNER_SPACE = re.compile(r"\s \s")
WORD_START = re.compile(r"(?= \S)")
#: A word that may stand between others of its kind in one string: no space, no white space at either end.
PLAIN = re.compile(r"[^\s](?:[^ ]*[^\s])?")
#: Words kept by one Python worker (about 90 MB at most), words of one string, and strings given to the library at once.
KEPT_WORDS = 450_000
STRING_WORDS = 500
STRINGS = 20
#: Characters of text in one batch of documents; one longer document makes a batch of its own.
BATCH_CHARS = 8_000_000

_ENCODERS: dict[str, "WordEncoder"] = {}


def space_led_words(text: str) -> list[str]:
    """The words of a text, each with the space before it; their concatenation is the text."""
    if INNER_SPACE.search(text):
        return WORD_START.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + word for word in rest]]


class WordEncoder:
    """Ids of whole texts as little-endian 16-bit or 32-bit integers, without special tokens, by a byte-level tokenizer
    file whose pre-tokens begin at every space before a character other than white space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        space = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(" ")[0][0]
        vocabulary = self.tokenizer.get_vocab()
        self.after_space = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.after_space[[i for token, i in vocabulary.items() if token.startswith(space)]] = True
        #: By key: a word without the space it is led by, or a space and a piece of text as it stands.
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, self.dtype) for found in
                self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _keys(text: str) -> list[str]:
        if INNER_SPACE.search(text):
            return [" " + part for part in WORD_START.split(text)]
        keys = text.split(" ")
        keys[0] = " " + keys[0]
        return keys

    def _learn(self, keys: list[str]) -> None:
        """Put keys among those known."""
        known, plain = self.known, list(filter(PLAIN.fullmatch, keys))
        for at in range(0, len(plain), STRING_WORDS * STRINGS):
            strings = [plain[k:k + STRING_WORDS]
                       for k in range(at, min(at + STRING_WORDS * STRINGS, len(plain)), STRING_WORDS)]
            for own, ids in zip(strings, self._library([" " + " ".join(own) for own in strings])):
                cuts = (np.flatnonzero(self.after_space[ids]) * ids.itemsize).tolist()
                if len(cuts) != len(own):
                    raise ValueError("the tokenizer does not cut before every space")
                data = ids.tobytes()
                known.update(zip(own, map(data.__getitem__, map(slice, cuts, [*cuts[1:], len(data)]))))
        other = list(set(keys).difference(plain)) if len(plain) < len(keys) else []
        for at in range(0, len(other), STRING_WORDS):
            own = other[at:at + STRING_WORDS]
            texts = [key[1:] if key[:1] == " " else " " + key for key in own]
            known.update(zip(own, [ids.tobytes() for ids in self._library(texts)]))

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        texts = ["" if text is None else text for text in texts]
        whole = [self.added is not None and self.added.search(text) is not None for text in texts]
        words = [[] if own else self._keys(text) for text, own in zip(texts, whole)]
        self._learn(list(set().union(*words) - self.known.keys()))
        get = self.known.__getitem__
        ids = [self._library([text])[0].tobytes() if own else b"".join(map(get, found))
               for text, found, own in zip(texts, words, whole)]
        if len(self.known) > KEPT_WORDS:  # what came last goes
            for word in list(itertools.islice(reversed(self.known), len(self.known) - KEPT_WORDS)):
                del self.known[word]
        return ids


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Free the worker's encoders; work that follows in the same worker needs none."""
    _ENCODERS.clear()


def in_batches(texts: list[str | None]) -> Iterator[slice]:
    """Slices of a list of texts of about BATCH_CHARS each."""
    start = chars = 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= BATCH_CHARS:
            yield slice(start, i + 1)
            start, chars = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def crc_of_ids(wide: int, ids: bytes) -> int:
    """CRC-32 of ids as little-endian 32-bit integers."""
    return zlib.crc32(ids if wide == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes())
