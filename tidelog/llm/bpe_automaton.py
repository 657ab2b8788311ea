"""BPE tokenization by a deterministic automaton over tokens.

The automaton begins as one state with an arc for each base symbol. Every merge (u, v) -> w is compiled
by a gadget, in merge order: where a u-arc is followed by a v-arc, the u-arcs are led to a copy of
their state that lacks v, and an arc w is added beside every u-arc, ending where the v-arc ends. The
automaton then accepts exactly the token sequences that BPE produces, one for each symbol string.

All arcs of one token share their target, so a merge makes one state. A state is stored as its parent
and the arc that it lacks, and which arcs it has follows from the order of the merges: w is present
where u is. Looked-up arcs are kept in a table.

A word is encoded by table-driven transitions in one pass: every position of it that a path reaches has one
state, as each prefix has one path only, and all arcs that leave it are followed to later positions. Nothing is
guessed or taken back. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, tokens

#: Words and arcs that a worker remembers.
MAX_WORDS, MAX_ARCS = 400_000, 1_000_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """Arcs are token ids. ``merges``: (left, right, result) in order of priority."""

    def __init__(self, merges: Iterable[tuple[int, int, int]], size: int):
        self.left, self.born, self.target = [-1] * size, [0] * size, [0] * size
        self.parent, self.lacks, self.made = [-1], [-1], [0]
        self.arcs: dict[int, bool] = {}
        for k, (u, v, w) in enumerate(merges, 1):
            state = self.target[u]
            if not self._walk(state, v):
                continue  # v never follows u, so w is never made
            self.left[w], self.born[w] = u, k
            self.target[w] = self.target[v]
            self.parent.append(state)
            self.lacks.append(v)
            self.made.append(k)
            self.target[u] = len(self.made) - 1
        self.usable = [self.born[t] > 0 or self.left[t] < 0 for t in range(size)]

    def _walk(self, state: int, token: int) -> bool:
        """Whether the state has the arc: no copy between them took it, nor the arc beside which it was added."""
        while True:
            while self.made[state] > self.born[token]:
                if self.lacks[state] == token:
                    return False
                state = self.parent[state]
            if self.left[token] < 0:
                return True
            token = self.left[token]

    def has_arc(self, state: int, token: int) -> bool:
        key = state << 32 | token
        found = self.arcs.get(key)
        if found is None:
            found = self._walk(state, token)
            if len(self.arcs) < MAX_ARCS:
                self.arcs[key] = found
        return found


class AutomatonTokenizer:
    """Encodes as the tokenizers library does with the same file, special tokens in texts included."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = model["vocab"]
        size = max([*vocab.values(), *self.added.values()]) + 1
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        joined = lambda a, b: (a.removesuffix(self.suffix) if self.suffix else a) + b
        results = [vocab[joined(a, b)] for a, b in pairs]
        self.automaton = MergeAutomaton([(vocab[a], vocab[b], w) for (a, b), w in zip(pairs, results, strict=True)], size)
        dead = {w for w in results if not self.automaton.born[w]}
        self.vocab = {s: t for s, t in vocab.items() if t not in dead}
        # every beginning of a token, with the token that it is or -1
        self.parts = {s[:k]: -1 for s in self.vocab for k in range(1, len(s))} | self.vocab
        self.labels = [""] * size
        for s, t in [*vocab.items(), *self.added.items()]:
            self.labels[t] = s
        library = Tokenizer.from_file(path)  # its normalizer and splitter, for texts that aren't plain
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.letters = byte_letters()
        self.lower = "Lowercase" in str(self.normalizer)
        self.pattern = tokens.piece_patterns()["word" if self.lower else "byte"]
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.starts = {s[:2] for s in self.added}
        self.known: dict[str, tuple[str, str]] = {}

    def encode_letters(self, word: str) -> list[int]:
        """Ids of one pre-split word, written in byte letters: one pass over its positions and the arcs that lead on from each."""
        n, known, arcs, has_arc, target = len(word), self.parts, self.automaton.arcs, self.automaton.has_arc, self.automaton.target
        states = [0] + [-1] * n  # a position has one state at most: a prefix of the word has one path
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        for at in range(n):
            state = states[at]
            if state < 0:
                continue
            row = state << 32
            for end in range(at + 1, n + 1):
                t = known.get(word[at:end])
                if t is None:
                    break
                if end == n and self.suffix:
                    t = self.vocab.get(word[at:end] + self.suffix, -1)
                if t >= 0 and states[end] < 0:
                    found = arcs.get(row | t)
                    if has_arc(state, t) if found is None else found:
                        states[end], came[end] = target[t], (at, t)
        if states[n] < 0:
            raise ValueError("the word has a letter outside the vocabulary")
        out = []
        while n:
            n, t = came[n]
            out.append(t)
        return out[::-1]

    def _words(self, text: str) -> Iterator[str]:
        """The text's words in byte letters, as the library's own normalizer and splitter give them."""
        if text:
            normal = self.normalizer.normalize_str(text) if self.normalizer else text
            yield from (w for w, _ in self.splitter.pre_tokenize_str(normal))

    def _plain(self, text: str) -> bool:
        return (text.isascii() or not tokens.NOT_PLAIN.search(text)) and not any(s in text for s in self.starts)

    def _in_letters(self, piece: str) -> str:
        return "".join(map(self.letters.__getitem__, piece.encode()))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cuts.split(text) if self.cuts else [text]:
            if part in self.added:
                out.append(self.added[part])
            else:
                for w in self._words(part):
                    out += self.encode_letters(w)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the ids' arcs; a file without a decoder joins them by a space."""
        return " ".join(self.labels[t] for t in ids)

    def encode_and_decode(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by spaces, and the decoded text; words met before are looked up."""
        if not self._plain(text):
            ids = self.encode(text)
            return " ".join(map(str, ids)), self.decode(ids)
        pieces = self.pattern.findall(text.lower() if self.lower else text)
        if not pieces:
            return "", ""
        found = list(map(self.known.get, pieces))
        if None in found:
            fresh: dict[str, tuple[str, str]] = {}
            for k, f in enumerate(found):
                if f is None:
                    p = pieces[k]
                    if p not in fresh:
                        ids = self.encode_letters(self._in_letters(p))
                        fresh[p] = " ".join(map(str, ids)), self.decode(ids)
                    found[k] = fresh[p]
            if len(self.known) < MAX_WORDS:
                self.known.update(fresh)
        ids, labels = zip(*found, strict=True)
        return " ".join(ids), " ".join(labels)


_loaded: dict[str, AutomatonTokenizer] = common.memory("automaton")


def automaton(path: str) -> AutomatonTokenizer:
    """One per worker process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = AutomatonTokenizer(path)
    return _loaded[path]


def tokenization_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode and decode every whole text. Columns: SCHEMA.

    Defined cases: a null or empty text has no ids, and both digests are those of the empty string; rows
    that repeat an id are kept side by side, null ids stay null; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = automaton(tokenizer_path)
        for b in common.slices(batches, owner="automaton"):
            n, a, d = [], [], []
            for text in b.column(1).to_pylist():
                ids, decoded = t.encode_and_decode(text)
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                d.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(d, pa.string())})

    return common.texts(docs).mapInArrow(run, SCHEMA)
