"""Exact Jaccard self-join of the documents' word n-gram sets, by partitioning the universe.

Two sets with Jaccard similarity t or more and sizes below u differ in at most H = (1-t)/(1+t) * 2(u-1)
n-grams. Sizes are dealt into bands; in a band, hashing splits the universe of n-grams into m segments
of which d also take the neighbourhood of one deletion, with m + d = H + 1 + e. By the pigeonhole
principle two similar sets agree on e + 1 segments, or differ by one n-gram on one of those d. A set's
signatures are its subsets by segment, and on d segments also each subset less one n-gram, but never an
empty subset, which unrelated sets would share: a segment counts 0 for a set that has nothing there, 2 if
it takes deletions and two n-grams or more, else 1, and each set takes deletions on its own first segments
until these sum to H + 1. Of two similar sets the one with fewer such segments differs from the other by
fewer n-grams than its sum, so they share a signature. A set that can't reach the sum takes deletions on
all segments, and empty subsets too, which only such sets need to share. m and d, for the mean set, are those of least cost:
signatures to ship against chance meetings, which grow with the square of the number of documents.

Documents with equal sets form a class. Buckets of the same classes count once. In each bucket of classes
that share a signature one class is the centre. Before any text is shipped, the others' sketches, how many
n-grams of a set fall in each of 256 parts of the universe, are held against the centre's: the sum of the
differences is at most that of the sets, so no similar pair is turned away. What is left is verified
against the centre, exactly, on whole texts. Links join classes to components. In buckets whose classes
still lie in different components, sketches of all pairs tell which classes may be linked at all; these are
joined to groups. A group is dealt into cells of bounded size, and each cell counts what its sets share
through an inverted index and hands on a spanning forest of the links between components. So no link that
would change a component is lost, and no pair of a cell is ever a row of its own.

N-grams, sets and buckets are compared by 64-bit digests.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph

WORDS, PERCENT = 3, 90
#: Ratio of a band's bounds; n-grams that one verifying group, or half a cell, holds.
BAND_RATIO, GROUP_NGRAMS = 1.5, 1_000_000
#: Cost of a chance meeting against that of a signature.
MEETING_COST = 20.0
#: Bytes of texts that are hashed together.
BYTES_AT_ONCE = 1 << 19
#: Parts of the universe that a sketch counts, sketches that half a cell and that a part of a centre's members hold, and
#: parts that a frequent signature's classes are dealt into.
SKETCH, HALF, MEMBERS, SALTS = 256, 2_048, 100_000, 1_024

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(int(base))
    if held is None or len(held) <= n:
        steps = np.full(max(2 * n, 1 << 17) + 1, base, np.uint64)
        steps[0] = 1
        held = _powers[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return held


def _hashed(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each maximal run of bytes other than 9 to 13 and 32, A-Z in lower case, and where it starts."""
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lower = b + np.where((b >= 65) & (b <= 90), 33, 1).astype(np.uint16)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lower * _powers_of(_PRIME, len(b))[: len(b)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * _powers_of(_INVERSE, len(b))[starts] + (ends - starts).astype(np.uint64)), starts


def _grams(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of word hashes; there are at least n words, or none."""
    out = np.full(max(0, len(w) - n + 1), n, np.uint64)
    for k in range(n):
        out = mix(out * _PRIME + w[k : len(w) - n + 1 + k])
    return out


def ngrams(text: str, words: int) -> np.ndarray:
    """Hashes of the n-grams in text order; fewer words than that make one n-gram."""
    return _together([text.encode("utf-8", "replace")], words)[0]


def ngrams_of(texts: list[str], words: int) -> list[np.ndarray]:
    """``ngrams`` of each of several texts, which are hashed together."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    out: list[np.ndarray] = []
    first = 0
    while first < len(raw):
        last, size = first + 1, len(raw[first])
        while last < len(raw) and size + len(raw[last]) <= BYTES_AT_ONCE:
            size += len(raw[last]) + 1
            last += 1
        out += _together(raw[first:last], words)
        first = last
    return out


def _together(raw: list[bytes], words: int) -> list[np.ndarray]:
    w, starts = _hashed(np.frombuffer(b"\n".join(raw), np.uint8))
    ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))
    firsts = np.concatenate([[0], ends[:-1]])
    grams = _grams(w, words) if len(w) >= words else w[:0]
    return [grams[a : b - words + 1] if b - a >= words else _grams(w[a:b], max(1, b - a)) for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def ngram_set(text: str, words: int = WORDS) -> np.ndarray:
    return distinct(ngrams(text, words))


def ngram_sets(texts: list[str], words: int) -> list[np.ndarray]:
    return [distinct(x) for x in ngrams_of(texts, words)]


def sketch(grams: np.ndarray) -> bytes:
    """How many n-grams are in each part of the universe, 255 at most, and the set's size in 8 bytes."""
    counts = np.bincount((mix(grams) >> np.uint64(56)).astype(np.int64), minlength=SKETCH)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + len(grams).to_bytes(8, "little")


def may_be_similar(one: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets may be similar, by sketches as rows of bytes: the sets differ in as many n-grams as the counts at least."""
    differ = np.abs(others[:, :SKETCH].astype(np.int16) - one[..., :SKETCH].astype(np.int16)).sum(1, dtype=np.int64)
    sizes = [np.ascontiguousarray(np.atleast_2d(x)[:, SKETCH:]).view("<u8")[:, 0].astype(np.int64) for x in (one, others)]
    return (100 + percent) * differ <= (100 - percent) * (sizes[0] + sizes[1])


def set_digest(grams: np.ndarray) -> int:
    """64 bits of a set, signed."""
    with np.errstate(over="ignore"):
        total = np.array([mix(grams).sum(dtype=np.uint64) + np.uint64(len(grams))])
    return int(mix(total).view(np.int64)[0])


class Bands:
    """Bands of set sizes, and how each allots its segments. ``documents``: how many there are, for the cost."""

    def __init__(self, percent: int, documents: int, ratio: float = BAND_RATIO):
        self.percent, self.documents, self.ratio = percent, max(documents, 2), ratio
        self.edges = [1]

    def _edge(self, k: int) -> int:
        while len(self.edges) <= k:
            self.edges.append(max(self.edges[-1] + 1, math.ceil(self.edges[-1] * self.ratio)))
        return self.edges[k]

    def of(self, size: int) -> Iterator[int]:
        """The bands in which a set of this size may meet one as large or larger."""
        k = 0
        while self._edge(k + 1) <= size:
            k += 1
        while self._edge(k) * self.percent <= 100 * size:
            yield k
            k += 1

    @lru_cache(maxsize=None)  # noqa: B019  one object a task
    def allotment(self, band: int) -> tuple[int, int, int]:
        """Segments, how many of them take one deletion, and how many empty ones a set may leave out: the cheapest
        for which the pigeonhole principle holds."""
        low, high = self._edge(band), self._edge(band + 1) - 1
        needed = (100 - self.percent) * 2 * high // (100 + self.percent) + 1
        best = (math.inf, needed, 0, 0)
        for deleting in {needed * k // 64 for k in range(33)}:
            segments = spare = needed - deleting
            if deleting > segments:
                continue
            empty = segments * math.exp(-low / segments)
            spare = math.ceil(empty + 4 * math.sqrt(empty)) if segments > 1 else 0
            segments += spare
            held = low / segments
            signatures = self.documents * (segments + deleting * (held + 1))
            # sets with more empty segments than they may leave out, and equal subsets of one n-gram
            meetings = self.documents**2 * (1e-4 + held / low) * segments * math.exp(-2 * held)
            best = min(best, (signatures + MEETING_COST * meetings * 1e-2, segments, deleting, spare))
        return best[1:]

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        """The set's distinct signatures, over all of its bands."""
        out = []
        with np.errstate(over="ignore"):
            spread = mix(grams ^ _PRIME)
            for band in self.of(len(grams)):
                segments, deleting, spare = self.allotment(band)
                segment = (mix(grams + np.uint64(band)) % np.uint64(segments)).astype(np.int64)
                sums = np.zeros(segments, np.uint64)
                np.add.at(sums, segment, spread)
                names = mix(np.arange(segments, dtype=np.uint64) + np.uint64(band << 32) + np.uint64(1))
                held = np.bincount(segment, minlength=segments)
                kept = held > 0
                missing = segments + deleting - spare - int(kept.sum())
                gained = np.cumsum(held > 1)
                if missing > gained[-1]:  # too few n-grams for these segments
                    deleting, kept, several = segments, held >= 0, held >= 0
                else:
                    deleting, several = int(np.searchsorted(gained, missing)) + 1 if missing > 0 else 0, held > 1
                out.append(mix(sums[kept]) + names[kept])
                if deleting:
                    has = (segment < deleting) & several[segment]
                    out.append(mix(sums[segment[has]] - spread[has]) + names[segment[has]])
            return distinct(mix(np.concatenate(out))) if out else np.zeros(0, np.uint64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def set_sizes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, cls, sketch of every row: size, digest and sketch of its set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            sets = ngram_sets(b.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n": pa.array(map(len, sets), pa.int64()), "cls": pa.array(map(set_digest, sets), pa.int64()), "sketch": pa.array(map(sketch, sets), pa.binary())})

    return common.texts(docs).mapInArrow(run, "doc_id long, n long, cls long, sketch binary")


def signatures(docs: DataFrame, words: int, percent: int, documents: int) -> DataFrame:
    """sig, cls: the signatures of each class, once for each task that meets it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, met = Bands(percent, documents), set()
        for b in common.slices(batches):
            sigs, classes, counts = [np.zeros(0, np.uint64)], [], []
            for grams in ngram_sets(b.column(1).to_pylist(), words):
                cls = set_digest(grams)
                if len(grams) and cls not in met:
                    met.add(cls)
                    sigs.append(bands.signatures(grams))
                    classes.append(cls)
                    counts.append(len(sigs[-1]))
            yield pa.RecordBatch.from_pydict({"sig": np.concatenate(sigs).view(np.int64), "cls": np.repeat(np.array(classes, np.int64), counts)})

    return common.texts(docs).mapInArrow(run, "sig long, cls long")


def shared_signatures(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """sig, cls of the signatures that several classes have, one signature for the same classes; and the frequent
    signatures, which are found on a sample of the documents: that decides how rows are dealt, never what comes out."""
    documents = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(common.SAMPLE)) == 0)
    counts = signatures(some, words, percent, documents).distinct().groupBy("sig").count()
    least = max(common.HOT_LEAST, documents // common.SAMPLE // 64)
    often = counts.where(F.col("count") > least).orderBy(F.desc("count"), "sig").limit(common.HOT_SHARE).select("sig").collect()
    hot = docs.sparkSession.createDataFrame(often, "sig long")
    with common.scratch(docs.sparkSession):
        flagged = signatures(docs, words, percent, documents).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "sig", "left")
        salted = flagged.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("cls"), F.lit(SALTS))).otherwise(F.lit(0)))
        bucket = Window.partitionBy("sig", "salt")
        several = salted.withColumns({"least": F.min("cls").over(bucket), "most": F.max("cls").over(bucket)}).where("least < most or hot").select("sig", "cls")
        found = common.staged(several.distinct(), "signatures")
        total = found.groupBy("sig").agg(F.count("*").alias("n"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("d"), F.sum(F.xxhash64("cls", F.lit(1)).cast("decimal(38,0)")).alias("e"))
        one = total.where("n > 1").groupBy("n", "d", "e").agg(F.min("sig").alias("sig")).select("sig")
        kept = found.join(F.broadcast(hot), "sig", "left_anti").join(one, "sig").unionByName(found.join(F.broadcast(hot), "sig", "left_semi"))
        return common.staged(kept, "buckets", keep=True), hot


def class_texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, n, text of the ``wanted`` classes (cls). ``classes``: cls, n, rep (a document of it)."""
    chosen = classes.join(wanted.distinct(), "cls").select("cls", "n", F.col("rep").alias("doc_id"))
    chosen = common.staged(chosen, "chosen")
    some, _ = common.split_by(common.texts(docs), ["doc_id"], chosen)  # few texts are wanted; all would be shipped
    found = some.join(chosen, "doc_id").groupBy("cls").agg(F.first("n").alias("n"), F.min("text").alias("text"))
    return common.staged(found, "candidates", compression="zstd")


def _beside_centre(pairs: DataFrame, held: DataFrame, payload: str, weight: str, least: int) -> DataFrame:
    """a, role, b, payload, dealt and sorted so that a centre (role 0) comes before its members (role 1).

    ``pairs``: a, b and the weight; ``held``: cls and the payload. Frequent centres' members are dealt into
    parts of bounded weight, each with the centre's own payload. Payloads join last.
    """
    parts = F.broadcast(common.parts_of(pairs, "a", F.col(weight), least))
    count = F.coalesce("parts", F.lit(1).cast("long"))
    members = pairs.join(parts, "a", "left").select("a", F.pmod(F.xxhash64("b"), count).alias("part"), F.lit(1).alias("role"), "b")
    centres = pairs.select("a").distinct().join(parts, "a", "left").select("a", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("b"))
    rows = centres.unionByName(members).join(held.select(F.col("cls").alias("b"), payload), "b")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "role", "b").select("a", "role", "b", payload)


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the ``pairs`` (a, b, n) that may be similar by the sketches of ``classes`` (cls, n, sketch)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros((1, SKETCH + 8), np.uint8)
        for batch in common.slices(batches, 4_096):
            rows = np.concatenate([centre, np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, SKETCH + 8)])
            member = np.concatenate([[False], batch.column(1).to_numpy() == 1])
            own = np.maximum.accumulate(np.where(member, 0, np.arange(len(rows))))
            centre = rows[own[-1]][None]
            keep = (member & may_be_similar(rows[own], rows, percent))[1:]
            yield pa.RecordBatch.from_pydict({"a": batch.column(0), "b": batch.column(2), "n": rows[1:, SKETCH:].copy().view("<i8")[:, 0]}).filter(pa.array(keep))

    return _beside_centre(pairs.withColumn("one", F.lit(1)), classes, "sketch", "one", MEMBERS).mapInArrow(run, "a long, b long, n long")


def verified(pairs: DataFrame, found: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the ``pairs`` (a: a centre, b, n of b) of classes whose sets are similar. ``found``: cls, text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in common.slices(batches):
            out: dict[str, list[int]] = {"a": [], "b": []}
            names = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            for (a, role, b), grams in zip(names, ngram_sets(batch.column(3).to_pylist(), words), strict=True):
                if role == 0:
                    centre = grams
                elif similar(centre, grams, percent):
                    out["a"].append(a)
                    out["b"].append(b)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return _beside_centre(pairs, found, "text", "n", GROUP_NGRAMS).mapInArrow(run, "a long, b long")


def compatible_pairs(cls: np.ndarray, component: np.ndarray, half: np.ndarray, rows: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of a cell's classes, edges that connect all pairs of different components (and halves, if there are two) that may be
    similar by their sketches, ``rows``. Only pairs with a class outside the largest component are looked at: there are no others."""
    size = np.ascontiguousarray(rows[:, SKETCH:]).view("<u8")[:, 0].astype(np.int64)
    order = np.argsort(size, kind="stable")
    cls, component, half, size, counts = cls[order], component[order], half[order], size[order], rows[order, :SKETCH].astype(np.int16)
    crosswise = half.any() and not half.all()
    names, n = np.unique(component, return_counts=True)
    if len(names) < 2:
        return []
    largest = names[n.argmax()] if n.max() > 1 else None
    coarse = counts.reshape(len(counts), -1, 4).sum(2, dtype=np.int32)  # differs at most as much; turns most pairs away
    # a similar set is neither much smaller nor much larger
    first, last = np.searchsorted(size, -(-size * percent // 100)), np.searchsorted(size, size * 100 // percent, "right")
    group, out = np.arange(len(cls)), []
    for k in range(len(cls)) if largest is None else np.flatnonzero(component != largest).tolist():
        part = slice(k + 1 if largest is None else int(first[k]), int(last[k]))
        most = (100 - percent) * (size[part] + size[k]) // (100 + percent)
        found = np.flatnonzero(np.abs(coarse[part] - coarse[k]).sum(1, dtype=np.int32) <= most) + part.start
        if not len(found):
            continue
        found = found[(component[found] != component[k]) & (group[found] != group[k])]
        if crosswise:
            found = found[half[found] != half[k]]
        found = found[np.abs(counts[found] - counts[k]).sum(1, dtype=np.int32) <= most[found - part.start]]
        joined, where = np.unique(group[found], return_index=True)
        out += [(int(cls[k]), int(cls[found[w]])) for w in where.tolist()]
        if len(joined):
            group[np.isin(group, joined)] = group[k]
    return out


def compatible(rest: DataFrame, hot: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect the classes of a bucket that may be linked, by sketches of all its pairs of different
    components: a spanning forest for each cell. ``rest``: sig, cls, component."""
    placed = common.with_totals(rest, "sig", hot, members=F.count("*")).withColumn("halves", F.ceil(F.col("members") / HALF)).withColumn("h", F.pmod(F.xxhash64("cls"), "halves"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("halves") - 1))
    cells = placed.withColumn("o", other).select("sig", F.least("h", "o").alias("i"), F.greatest("h", "o").alias("j"), "cls", "component", (F.col("h") > F.col("o")).alias("half"))
    cells = cells.join(classes.select("cls", "sketch"), "cls").select("sig", "i", "j", "cls", "component", "half", "sketch")

    def edges(held: list[tuple]) -> list[tuple[int, int]]:
        cls, component, half = (np.array(x) for x in list(zip(*held, strict=True))[:3])
        rows = np.frombuffer(b"".join(r[3] for r in held), np.uint8).reshape(-1, SKETCH + 8)
        return compatible_pairs(cls, component, half, rows, percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for b in common.slices(batches):
            for sig, i, j, *row in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if (sig, i, j) != key:
                    out += edges(held) if len(held) > 1 else []
                    key, held = (sig, i, j), []
                held.append(tuple(row))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
            out = []
        out = edges(held) if len(held) > 1 else []
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return cells.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "cls").mapInArrow(run, "a long, b long").distinct()


def cell_links(sets: list[np.ndarray], components: list[int], half: list[bool], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between different components, of pairs with one set in each half
    (in one half if the other is empty), as positions. Sets shared counts come from an inverted index."""
    inside = all(half) or not any(half)
    left = [k for k in range(len(sets)) if inside or not half[k]]
    right = [k for k in range(len(sets)) if inside or half[k]]
    if not left or not right:
        return []
    lengths = np.array([len(sets[k]) for k in right])
    grams = np.concatenate([sets[k] for k in right])
    order = np.argsort(grams, kind="stable")
    sorted_grams, owner = grams[order], np.repeat(np.arange(len(right)), lengths)[order]
    names = np.array([components[k] for k in right])
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out = []
    for k in left:
        low, high = np.searchsorted(sorted_grams, sets[k], "left"), np.searchsorted(sorted_grams, sets[k], "right")
        counts = high - low
        at = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        both = np.bincount(owner[at], minlength=len(right))
        hit = (100 * both >= percent * (len(sets[k]) + lengths - both)) & (names != components[k]) & (both > 0)
        for j in np.flatnonzero(hit).tolist():
            x, y = find(components[k]), find(components[right[j]])
            if x != y:
                parent[x] = y
                out.append((k, right[j]))
    return out


def group_links(members: DataFrame, found: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components inside groups. ``members``: cls, component, grp; ``found``: cls, n, text."""
    sized = members.join(found.select("cls", "n"), "cls")
    halves = sized.groupBy("grp").agg(F.ceil(F.sum("n") / GROUP_NGRAMS).alias("halves"))
    placed = sized.join(halves, "grp").withColumn("h", F.pmod(F.xxhash64("cls"), "halves"))
    # a set goes to each cell (i, j), i <= j, that its part h belongs to
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("halves") - 1))
    cells = placed.withColumn("o", other).select("grp", F.least("h", "o").alias("i"), F.greatest("h", "o").alias("j"), "cls", "component", (F.col("h") > F.col("o")).alias("half"))
    cells = cells.join(found.select("cls", "text"), "cls").select("grp", "i", "j", "cls", "component", "text", "half")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            found = cell_links(sets, components, half, percent)
            return pa.RecordBatch.from_pydict({"a": pa.array([classes[x] for x, _ in found], pa.int64()), "b": pa.array([classes[y] for _, y in found], pa.int64())})

        key, sets, components, half, classes = None, [], [], [], []
        for b in common.slices(batches):
            grams = ngram_sets(b.column(5).to_pylist(), words)
            for own, grp, i, j, cls, component, in_half in zip(grams, *(b.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 6)), strict=True):
                if (grp, i, j) != key:
                    yield flush()
                    key, sets, components, half, classes = (grp, i, j), [], [], [], []
                sets.append(own)
                components.append(component)
                half.append(in_half)
                classes.append(cls)
        yield flush()

    return cells.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "cls").mapInArrow(run, "a long, b long")


def _labels(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of the classes that are linked with others. ``classes``: cls, n, rep, sketch."""
    spark = docs.sparkSession
    buckets, hot = shared_signatures(docs, words, percent)
    with common.scratch(spark):
        centred = common.with_totals(buckets, "sig", hot, c=F.min(F.struct(F.xxhash64("cls"), "cls")))
        pairs = common.staged(centred.select(F.col("c.cls").alias("a"), F.col("cls").alias("b")).where("a <> b").distinct(), "pairs")
        pairs = common.staged(possible(pairs, classes, percent), "possible")
        texts = class_texts(docs, classes, pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))))
        links = common.staged(verified(pairs, texts, words, percent), "links", keep=True)
    with common.scratch(spark):
        labels = common.staged(graph.components(links), "labels")
        labelled = buckets.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        labelled = common.staged(labelled, "labelled")
        mixed = common.with_totals(labelled, "sig", hot, least=F.min("component"), most=F.max("component")).where("least < most")
        rest = common.staged(mixed.select("sig", "cls", "component"), "rest")
        edges = common.staged(compatible(rest, hot, classes, percent), "edges")
        groups = graph.components(edges)
        members = rest.select("cls", "component").distinct().join(groups.select(F.col("node").alias("cls"), F.col("component").alias("grp")), "cls")
        members = common.staged(members, "members")
        more = common.staged(group_links(members, class_texts(docs, classes, members.select("cls")), words, percent), "links", keep=True)
    return graph.components(links.unionByName(more))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Defined cases: a null text, or one without words, has an empty set that is linked with nothing, its
    component its own id; rows that repeat an id and text give as many rows; a null id gives a null
    component unless linked; an empty table gives no rows; other columns are ignored.
    """
    with common.scratch(docs.sparkSession):
        every = common.staged(set_sizes(docs, words), "sketches", compression="zstd")
        sizes = common.staged(every.drop("sketch"), "sizes", keep=True)
        some = every.where("n > 0 and doc_id is not null")
        sketched = common.staged(some.groupBy("cls").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")), "sketched", compression="zstd")
        classes = common.staged(sketched.drop("sketch"), "classes", keep=True)
        labels = common.staged(_labels(docs, sketched, words, percent), "labels", keep=True)
    named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    first = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    member = named.join(first, "component").select("cls", "component_id")
    out = sizes.where("n > 0").join(member, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(sizes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one_of_each(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of ``docs`` whose id is their component's least; one row of those that repeat an id and text.

    Rows without an id are no copies of others; of those with the same text one stays. Empty texts stay. The
    columns are those of ``docs``, whatever their names; an empty table gives no rows.
    """
    named = jaccard_components(docs, words, percent).where("doc_id is not null").groupBy(F.col("doc_id").alias("__doc"))
    ids = common.staged(named.agg(F.bool_or(F.expr("doc_id = component_id")).alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1"), "ids")
    rows = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__txt"), F.xxhash64(*docs.columns).alias("__order"))
    again = F.row_number().over(Window.partitionBy("__doc", "__txt").orderBy("__order"))  # in the join's partitions
    # ids of one row, which stays, are the most; their rows stay where they are
    some, single = common.split_by(rows, ["__doc"], ids)
    stay = some.join(ids.where("not kept"), "__doc", "left_anti").withColumn("__again", again).where("__again = 1")
    return single.select("__row.*").unionByName(stay.select("__row.*")).unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))
