"""Encoding with the `tokenizers` library, one distinct word at a time.

Both supported layouts (lower-casing word BPE, byte-level BPE) split a text into pieces that are
encoded independently, so the library needs to see each distinct piece once; ids of a document are
the concatenation over its pieces. Pieces of the lower-casing layout hold no white space, so there
texts are split at it, and what lies between is remembered. Texts with any character outside a proven range, or that hold
the start of an added token, go to the library whole, so results are always the library's own.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

from . import common

#: Most distinct pieces that one worker remembers, characters that these have at most, and characters split at once.
MAX_REMEMBERED, LONGEST, CHARS_AT_ONCE = 700_000, 64, 1_000_000

#: The contractions that both tokenizers split off, and Unicode white space below U+0180.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WHITE = "\t\n\x0b\x0c\r \x85\xa0"
#: Fixed value: what else Python splits at below U+0180.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Fixed value: how byte-level vocabularies write a space.
SPACE = "\u0120"

#: Characters whose NFC form is themselves and whose lower case is one character of the same range.
PLAIN = [chr(c) for c in range(0x180) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x180]


def char_class(chars: Iterable[str]) -> str:
    """The inside of a regex character class for these characters, as ranges."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


def _category(kind: str) -> str:
    return char_class(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == kind)


def piece_patterns() -> dict[str, re.Pattern]:
    letter, number, white = _category("L"), _category("N"), char_class(WHITE)
    return {
        "word": re.compile(f"{CONTRACTIONS}|[{letter}]+|[{number}]|[^{white}{letter}{number}]+"),
        "byte": re.compile(f"{CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+"),
    }


NOT_PLAIN = re.compile(f"[^{char_class(PLAIN)}]")


class PieceTokenizer:
    """Ids of whole texts as little-endian bytes, by the library, through a memory of pieces."""

    def __init__(self, path: str, max_remembered: int = MAX_REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.lower = "Lowercase" in str(self.library.normalizer)
        self.pattern = piece_patterns()["word" if self.lower else "byte"]
        added = {t.content: k for k, t in self.library.get_added_tokens_decoder().items()}
        self.cut, self.cut_id = max(added.items(), key=lambda x: x[1])
        self.starts = {t[:2] for t in added}
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.word = re.compile(f"{'' if self.lower else ' '}[{_category('L')}]+")
        self.digit = "1" if self.lower else ""
        vocabulary = self.library.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[k for t, k in vocabulary.items() if (t == self.digit if self.lower else t.startswith(SPACE))]] = True
        # a lower-case ASCII word needs no more than the model, which marks its end
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        suffix = self.lower and self.library.model.end_of_word_suffix
        self.last = np.zeros(len(self.begins), bool)
        self.last[[k for t, k in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.max_remembered = max_remembered

    def ids(self, text: str) -> np.ndarray:
        """The library's ids of one whole text."""
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def is_plain(self, text: str) -> bool:
        return (text.isascii() or not NOT_PLAIN.search(text)) and not any(a in text for a in self.starts)

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text.lower() if self.lower else text)

    def _split(self, text: str) -> list[str]:
        """What is remembered of a text: its pieces, or what lies between its white space."""
        if self.lower and not any(c in text for c in SEPARATORS):
            return text.lower().split()
        return self.pieces(text)

    def _learn_all(self, fresh: list[str]) -> None:
        """Learn what ``_split`` gave."""
        several = {x: self.pattern.findall(x) for x in fresh if not x.isalpha()} if self.lower else {}
        pieces = {p for x in several.values() for p in x}.union(x for x in fresh if x not in several)
        self._learn(list(pieces.difference(self.known)))
        self.known.update((x, b"".join(map(self.known.__getitem__, ps))) for x, ps in several.items() if len(ps) > 1)

    def _learn(self, pieces: list[str]) -> None:
        """One call for many pieces. ASCII words of the lower-casing layout are told apart by the tokens that end words.
        Other words are by the digit between them, or by the space that each begins with; other pieces by an added
        token between them, which is slower."""
        if self.last.any():
            words = [p for p in pieces if p.isascii() and p.isalpha()]
            ids = np.asarray(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.last[ids]) + 1
            if words and len(last) == len(words):
                self._remember(words, ids, np.concatenate([[0], last[:-1]]), last)
                pieces = [p for p in pieces if p not in self.known]
        words = [p for p in pieces if self.word.fullmatch(p)]
        if words:
            ids = self._together(self.digit.join(words))
            first = np.flatnonzero(self.begins[ids]) + self.lower
            first = np.concatenate([[0], first]) if self.lower else first
            if len(first) == len(words):
                self._remember(words, ids, first, np.append(first[1:] - self.lower, len(ids)))
                pieces = [p for p in pieces if p not in self.known]
        if pieces:
            ids = self._together(self.cut.join(pieces))
            cuts = np.flatnonzero(ids == self.cut_id)
            self._remember(pieces, ids, np.concatenate([[0], cuts + 1]), np.append(cuts, len(ids)))

    def _together(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _remember(self, pieces: list[str], ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        packed, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        self.known.update(zip(pieces, (packed[a:b] for a, b in zip((first * size).tolist(), (last * size).tolist(), strict=True)), strict=True))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= CHARS_AT_ONCE):
                chars += len(texts[end])
                end += 1
            yield from self._encode_some(texts[start:end])
            start = end

    def _encode_some(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [self._split(t) if self.is_plain(t) else None for t in texts]
        before = len(self.known)
        fresh = set().union(*(x for x in split if x)).difference(self.known)
        if fresh:
            self._learn_all(list(fresh))
        for text, x in zip(texts, split, strict=True):
            yield self.ids(text) if x is None else np.frombuffer(b"".join(map(self.known.__getitem__, x)), self.dtype)
        if len(self.known) > self.max_remembered:  # what came first is the most frequent
            while len(self.known) > before:
                self.known.popitem()
        elif fresh:
            for x in list(islice(reversed(self.known), len(self.known) - before)):
                if len(x) > LONGEST:
                    del self.known[x]


_loaded: dict[str, PieceTokenizer] = common.memory("pieces")


def tokenizer(path: str) -> PieceTokenizer:
    """One per worker process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = PieceTokenizer(path)
    return _loaded[path]


def public_path(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
