"""Language identification by compression.

For each language a zstandard compressor holds a raw-content dictionary of that language's text. A
text's distinct words (letters in lower case, in the order in which they first appear, so that
repetition doesn't hide the language) are encoded block by block with every dictionary; the language whose blocks come out smallest is chosen. Each block follows an anchor, a
passage of the dictionary's language that warms the coder up and whose own size is taken off, so that
even a word changes the size; several dictionaries a language make the sizes finer than whole bytes.
If the lead over the second language is too narrow, the text is rejected.

The dictionaries are cut from a bounded sample of training documents, its size a parameter.

Defined cases: a null text or one without a letter is `und` with score 0 and rejected; without any
training text every document is `und`; ties go to the language first by name; rows that repeat an id
are kept side by side, null ids stay null and are never held out; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the fit: documents a language, characters of each, bytes of a dictionary, dictionaries a language.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES, DICTIONARIES, ANCHOR = 400, 2_000, 48_000, 3, 1_000
FOLDS, HELD_OUT = 5, 0
BLOCK, LEVEL = 16_384, 3
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Bytes (mean over a language's dictionaries) by which the best language has to lead, and as a share of its size. Of
#: 2,500 documents in known languages, 1 in 200 leads by less than 0.073 and 1 in 1,000 by less than 0.014.
MIN_MARGIN, MIN_LEAD = 0.3, 0.01
UNDETERMINED = "und"


def distinct_words(text: str) -> bytes:
    return " ".join(dict.fromkeys(NOT_LETTERS.sub(" ", text.lower()).split())).encode("utf-8", "replace")


class CompressionClassifier:
    """Chooses among the languages of ``dictionaries``: language -> raw contents."""

    def __init__(self, dictionaries: dict[str, list[bytes]], min_margin: float = MIN_MARGIN):
        self.dictionaries, self.min_margin = dictionaries, min_margin
        self._compressors: list[list[tuple]] | None = None

    def __getstate__(self) -> tuple:
        return self.dictionaries, self.min_margin

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def sizes(self, text: str) -> np.ndarray:
        """Encoded bytes of the whole text for each language, the mean over its dictionaries."""
        if self._compressors is None:
            self._compressors = self._prepare()
        data = distinct_words(text)
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return np.array([sum(len(c.compress(anchor + b)) - base for c, anchor, base in cs for b in blocks) / len(cs) for cs in self._compressors])

    def _prepare(self) -> list[list[tuple]]:
        """For each language and dictionary a compressor, its anchor and the anchor's size."""
        import zstandard as z

        out = []
        for raws in self.dictionaries.values():
            out.append([])
            for raw in raws:
                anchor, raw = raw[:ANCHOR], raw[ANCHOR:]
                params = z.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK + ANCHOR, dict_size=len(raw), write_content_size=0, write_checksum=0, write_dict_id=0)
                held = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=params)
                c = z.ZstdCompressor(dict_data=held, compression_params=params)
                out[-1].append((c, anchor, len(c.compress(anchor))))
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (1 over the sum of 2 to the bits by which each language is behind), rejected."""
        if not self.dictionaries or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(text)
        best = int(np.argmin(sizes))
        behind = sizes - sizes[best]
        margin = np.partition(behind, 1)[1] if len(sizes) > 1 else np.inf
        return list(self.dictionaries)[best], float(1 / np.exp2(-np.minimum(behind * 8, 1000)).sum()), bool(margin < max(self.min_margin, MIN_LEAD * sizes[best]))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, min_margin: float = MIN_MARGIN) -> CompressionClassifier:
    """Dictionaries of the languages that training documents name."""
    named = common.texts(docs, "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & (common.id_remainder("doc_id", FOLDS) != HELD_OUT))
    counts = dict(sorted(named.groupBy("lang").count().collect()))
    if not counts:
        return CompressionClassifier({}, min_margin)
    draw = F.xxhash64("doc_id")
    below = F.coalesce(*(F.when(F.col("lang") == lang, int(min(1.0, 2 * sample_docs / n) * (1 << 40)) + 1) for lang, n in counts.items()))
    sample = named.where(F.pmod(draw, F.lit(1 << 40)) < below).select("lang", draw.alias("draw"), "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    texts: dict[str, list[str]] = {lang: [] for lang in counts}
    for r in sample.limit(4 * sample_docs * len(counts)).orderBy("draw", "doc_id", "text").collect():
        texts[r.lang].append(r.text)
    dictionaries = {}
    for lang, found in texts.items():
        found = list(dict.fromkeys(found))[:sample_docs]
        parts = [distinct_words(" ".join(found[k::DICTIONARIES]))[: DICTIONARY_BYTES + ANCHOR] for k in range(DICTIONARIES)]
        parts = [p if len(p) >= 2 * ANCHOR else p * (2 * ANCHOR // len(p) + 1) for p in parts if p.strip()]
        if parts:
            dictionaries[lang] = parts
    return CompressionClassifier(dictionaries, min_margin)


def identified(docs: DataFrame, model: CompressionClassifier) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            lang, score, rejected = zip(*map(model.predict, b.column(1).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())})

    out = common.texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", F.coalesce(common.id_remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, model: CompressionClassifier) -> DataFrame:
    """The rows of ``docs``, all columns, that are not rejected."""
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            yield b.filter(pa.array([not model.predict(t)[2] for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
