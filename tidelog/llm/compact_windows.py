"""Near-duplicate passages by compact windows.

A text is a sequence of tokens, its word 5-grams. Under one hash function, the Cartesian tree of the
tokens' hashes groups all subsequences by the token that is their minimum: a node at c over [l, r]
stands for every subsequence [i, j] with l <= i <= c <= j <= r, which all share the min-hash of c. Nodes
at least as wide as a passage are the compact windows; there are about 2n / width of them. Equal minima
of one range are nodes of the whole range; of a run that repeats itself only the first and last are kept.

Windows of different texts that share a min-hash meet in a bucket, where the window of the least document
is the centre of the others. An interval join keeps the pairs of texts of which windows of two functions or
more meet, overlapping in both texts by a passage's width. They are verified: from a shared token, the
stretch inside both windows is extended and accepted if it is long enough and the Jaccard similarity of the
two passages' tokens is high enough. Then every bucket that holds a window without a passage from the
centre is taken whole, in cells of bounded size: all pairs of its windows that could still join two
components are compared by the tokens around them, on this one function. So neither a frequent line nor an
edited copy in a lesser document hides the passages around it.

Texts are told apart by 64-bit digests; documents with equal texts are looked at once. A passage of
similarity s is missed if no function agrees, with four functions and s = 0.8 one time in 625; exact
repeats share every min-hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .set_join import _PRIME, _powers_of, distinct, mix, ngrams_of

#: Words of a token, words that a passage has at least, percent of similarity, hash functions (at most 8), tokens that a verifying group holds.
WORDS, MIN_WORDS, PERCENT, FUNCTIONS, GROUP_TOKENS = 5, 50, 80, 4, 2_000_000
#: Tokens that one half of a cell holds; windows up to which a cell compares all pairs without an index, and those
#: that share tokens are not looked for first; passes that start from one window. All but the first for speed only.
CELL_TOKENS, FEW, MANY, LEADERS = 2_000_000, 6, 64, 8
#: Windows of cells that are looked at at once, 4,096 at most; for speed only.
CELLS_AT_ONCE = 4_096
#: Tokens on each side of its own that a window brings to a cell, 3 widths at least; different tokens on a side up to which pairs
#: are looked at at once, pairs from which that pays, bits by which tokens are told apart there. For speed only.
HELD, OUTWARD, PAYS, BITS = 1_024, 128, 4, 12
#: Parts of each function's keys, and bytes of windows that a task takes up at once.
PARTS, PACKED_BYTES = 256, 32_000_000
_SEEDS = [np.uint64(0xA0761D6478BD642F * (2 * j + 1) & (1 << 64) - 1) for j in range(8)]
_WINDOW = "key long, txt long, c int, l int, r int"
_PASSAGE = "a long, a_txt long, a_start int, a_end int, b long, b_txt long, b_start int, b_end int, similarity double, cuts array<int>"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
_ARROW = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in _PASSAGE.split(", ")])


def among(x: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``pool``, which isn't empty."""
    at = pool.searchsorted(x)
    at[at == len(pool)] = 0
    return pool[at] == x


def _sliding(least: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The least (or largest) of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _beyond(at: np.ndarray, v: np.ndarray, equal: bool) -> np.ndarray:
    """From the neighbours ``at`` on to the first that is less, or ``equal``; zeros stay."""
    todo = np.flatnonzero(v)
    while len(todo):
        todo = todo[v[at[todo]] > v[todo]] if equal else todo[v[at[todo]] >= v[todo]]
        at[todo] = at[at[todo]]
    return at


def windows(hashes: np.ndarray, width: int, tokens: np.ndarray | None = None) -> np.ndarray:
    """Rows l, c, r of the Cartesian tree's nodes that are at least so wide. ``hashes`` are positive, but for zeros
    that begin, part and end texts. Equal minima have one range; with ``tokens``, those inside a periodic run are left out."""
    if len(hashes) < width:
        return np.zeros((0, 3), np.int64)
    margin = np.zeros(width - 1, np.uint64)
    best = _sliding(np.maximum, np.concatenate([margin, _sliding(np.minimum, hashes, width), margin]), width)
    place = np.flatnonzero(best == hashes)  # the least of some range that is wide enough, and the zeros
    v, k = hashes[place], np.arange(len(place))
    left, right = _beyond(np.maximum(k - 1, 0), v, False), _beyond(np.minimum(k + 1, len(k) - 1), v, False)
    keep = v > 0
    if tokens is not None:
        before, after = _beyond(np.maximum(k - 1, 0), v, True), _beyond(np.minimum(k + 1, len(k) - 1), v, True)
        tied = np.flatnonzero(keep & (v[before] == v) & (v[after] == v))
        back, on = place[tied] - place[before[tied]], place[after[tied]] - place[tied]
        tied, step = tied[back == on], on[back == on]
        power = _powers_of(_PRIME, len(tokens))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * power[: len(tokens)], dtype=np.uint64)])
        here, first, last = (sums[place[x]] for x in (tied, before[tied], after[tied]))
        keep[tied[(here - first) * power[step] == last - here]] = False
    x = np.flatnonzero(keep)
    return np.column_stack([place[left[x]] + 1, place[x], place[right[x]] - 1])


def text_digest(text: str) -> int:
    """Spark's xxhash64 of a text."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def digest_column() -> Column:
    return F.xxhash64("text").alias("txt")


def all_windows(docs: DataFrame, words: int, width: int, functions: int) -> DataFrame:
    """The windows of every distinct text, ``packed``, once for each task that meets it; the low 3 bits of a key name the function.
    A text that has windows has one more, without a key, whose c is its number of words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in common.slices(batches):
            names, own = [], []
            for txt, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if txt not in met:
                    met.add(txt)
                    names.append(txt)
                    own.append(text)
            tokens = [(n, t) for n, t in zip(names, ngrams_of(own, words), strict=True) if len(t) >= width]
            if not tokens:
                continue
            zero = np.zeros(1, np.uint64)
            row = np.concatenate([zero, *(x for _, t in tokens for x in (t, zero))])
            ends = np.cumsum([len(t) + 1 for _, t in tokens])
            starts = np.concatenate([[0], ends[:-1]]) + 1
            parting = np.concatenate([[0], ends])
            every = np.array([n for n, _ in tokens], np.int64)
            sizes, none = np.array([len(t) + words - 1 for _, t in tokens], np.int32), np.zeros(len(tokens), np.int32)
            yield pa.RecordBatch.from_pydict({"key": pa.nulls(len(tokens), pa.int64()), "txt": every, "c": sizes, "l": none, "r": none})
            for j in range(functions):
                hashes = mix(row ^ _SEEDS[j]) | np.uint64(1)
                hashes[parting] = 0
                found = windows(hashes, width, row)
                text = np.searchsorted(ends, found[:, 1])
                keys = (hashes[found[:, 1]] & ~np.uint64(7) | np.uint64(j)).view(np.int64)
                left, c, right = (found - starts[text][:, None]).astype(np.int32).T
                yield pa.RecordBatch.from_pydict({"key": keys, "txt": every[text], "c": c, "l": left, "r": right})

    return common.texts(docs).select(digest_column(), "text").mapInArrow(lambda batches: map(packed, run(batches)), "part int, data binary")


def packed(b: pa.RecordBatch) -> pa.RecordBatch:
    """Windows (columns _WINDOW) with many in one row, by a part of their key: part, and the columns one after the other.
    Windows without a key are one row, of txt and c, without a part."""
    if b.column(0).null_count:
        data = b"".join(b.column(k).to_numpy().tobytes() for k in (1, 2))
        return pa.RecordBatch.from_pydict({"part": pa.nulls(1, pa.int32()), "data": pa.array([data], pa.binary())})
    columns = [b.column(k).to_numpy() for k in range(5)]
    part = ((columns[0] & 7) * PARTS + (columns[0] >> 8) % PARTS).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [x[order] for x in columns]
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
    data = [b"".join(x[i:j].tobytes() for x in columns) for i, j in zip(edges, edges[1:])]
    return pa.RecordBatch.from_pydict({"part": pa.array(part[edges[:-1]]), "data": pa.array(data, pa.binary())})


def unpacked(data: list[bytes], types: tuple[str, ...]) -> list[np.ndarray]:
    """The columns of several packed rows."""
    width = sum(np.dtype(t).itemsize for t in types)
    out: list[list[np.ndarray]] = [[] for _ in types]
    for d in data:
        n, at = len(d) // width, 0
        for x, t in zip(out, types, strict=True):
            x.append(np.frombuffer(d, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, types, strict=True)]


def shared_windows(rows: DataFrame) -> DataFrame:
    """Of ``packed`` windows those whose key another text has too. Columns: _WINDOW.

    A task holds the windows of keys that it has met with one text only; those of others are handed on at once, so
    that a frequent key isn't gathered.
    """
    arrow = pa.schema([("key", pa.int64()), ("txt", pa.int64()), ("c", pa.int32()), ("l", pa.int32()), ("r", pa.int32())])
    types = ("i8", "i8", "i4", "i4", "i4")

    def told_apart(held: list[np.ndarray], known: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """The windows with keys of several texts, the others, and the keys of the first."""
        order = np.lexsort((held[1], held[0]))
        held = [x[order] for x in held]
        starts = np.flatnonzero(np.concatenate([[True], held[0][1:] != held[0][:-1]]))
        sizes = np.diff(np.append(starts, len(order)))
        several = held[1][starts] != held[1][starts + sizes - 1]
        if len(known):
            several |= among(held[0][starts], known)
        known, kept = np.union1d(known, held[0][starts[several]]), np.repeat(several, sizes)
        return [x[kept] for x in held], [x[~kept] for x in held], known

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rest, known, data, size = None, [np.zeros(0, t) for t in types], np.zeros(0, np.int64), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rest, known, data, size
            rest = [np.concatenate(x) for x in zip(rest, unpacked(data, types), strict=True)]
            data, size = [], 0
            if len(rest[0]):
                found, rest, known = told_apart(rest, known)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=arrow)

        for b in batches:
            for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != part:
                    yield from flush()
                    part, rest, known = p, [np.zeros(0, t) for t in types], np.zeros(0, np.int64)
                data.append(d)
                size += len(d)
                if size > max(PACKED_BYTES, 28 * len(rest[0])):
                    yield from flush()
        yield from flush()

    dealt = rows.where("part is not null").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, _WINDOW)


def _scores(a: np.ndarray, b: np.ndarray, seed: tuple[int, ...], width: int, percent: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of b's tokens added up from the seed to the left and to the right, so far at most."""
    ca, la, ra, cb, lb, rb = seed
    # a similarity of s needs 2s / (1 - s) shared tokens for each that is not shared
    cost = 2 * percent / (100 - percent)
    first, last = max(lb, cb - reach), min(rb, cb + reach)
    own = a[max(la, ca - reach - width) : min(ra, ca + reach + width) + 1]
    score = np.where(among(b[first : last + 1], np.sort(own)), 1.0, -cost)
    return np.cumsum(score[: cb - first + 1][::-1]), np.cumsum(score[cb - first :])


def stretch_near(a: np.ndarray, b: np.ndarray, seed: tuple[int, ...], width: int, percent: int) -> tuple[int, int] | None:
    """How far similar tokens go in ``b``, to 2 widths at most, if that makes a passage; only tokens at most 3 widths from the seed count."""
    x, y = _longest(*_scores(a, b, seed, width, percent, 2 * width))
    return (x, y) if x + y + 1 >= width else None


def passage_of(a: np.ndarray, b: np.ndarray, seed: tuple[int, ...], x: int, y: int, width: int, percent: int, words: int) -> tuple | None:
    """The passage of ``b`` from x before the seed to y after it and a's beside it, if they are long and similar enough;
    last, ends of the runs of b's words that are in shared tokens."""
    ca, la, ra, cb, _, _ = seed
    start, end = cb - x, cb + y
    first = max(la, ca - x - width // 4)
    # the part of a's window that runs along with it
    other = distinct(b[start : end + 1])
    near = np.flatnonzero(among(a[first : min(ra, ca + y + width // 4) + 1], other)) + first
    a_start, a_end = int(near[0]), int(near[-1])
    if end - start + 1 < width or a_end - a_start + 1 < width:
        return None
    own = distinct(a[a_start : a_end + 1])
    both = own[among(own, other)]
    similarity = len(both) / (len(own) + len(other) - len(both))
    if 100 * similarity < percent:
        return None
    covered = np.convolve(among(b[start : end + 1], both), np.ones(words, np.int64)) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]))) + start
    return a_start, a_end + words, start, end + words, similarity, edges.tolist()


def passage_around(a: np.ndarray, b: np.ndarray, seed: tuple[int, ...], width: int, percent: int, words: int, failed: tuple | None = None) -> tuple | None:
    """The best similar passages around a shared token: seed is c, l, r in ``a``, then in ``b``. ``failed`` is what
    ``stretch_near`` gave if that is known to make none."""
    ca, _, ra, cb, _, rb = seed
    if ra >= len(a) or rb >= len(b) or a[ca] != b[cb]:
        return None
    near = failed or stretch_near(a, b, seed, width, percent)
    if near is None:
        return None
    left, right = _scores(a, b, seed, width, percent, len(a) + len(b))
    for x, y in dict.fromkeys((_longest(left, right), (int(left.argmax()), int(right.argmax())), near)):
        found = (x, y) != failed and passage_of(a, b, seed, x, y, width, percent, words)
        if found:
            return found
    return None


def _longest(left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
    """How far the longest stretch around the seed goes whose score is not negative; both sums begin with the seed's 1."""
    best_beyond = np.maximum.accumulate(right[::-1])  # over ends that are as far or farther, the farthest first
    y = len(right) - 1 - np.searchsorted(best_beyond, 1 - left)
    y = np.where(y < 0, -len(left) - len(right), y)
    x = int((np.arange(len(left)) + y).argmax())
    return x, int(y[x])


def pair_passages(a: np.ndarray, a_sorted: np.ndarray, b: np.ndarray, seeds: np.ndarray, width: int, percent: int, words: int) -> Iterator[tuple]:
    """The passages of two texts' tokens around these seeds."""
    seeds = seeds[(seeds[:, 3] < len(a)) & (seeds[:, 6] < len(b))]  # rows that repeat an id may have another text
    if not len(seeds):
        return
    # a passage has enough tokens near the seed that the other text has somewhere
    both = np.concatenate([[0], np.cumsum(among(b, a_sorted))])
    share = 2 * percent / (100 + percent)
    reach = 2 * width
    first, last = np.maximum(seeds[:, 5], seeds[:, 4] - reach), np.minimum(seeds[:, 6], seeds[:, 4] + reach)
    seeds = seeds[both[last + 1] - both[first] >= np.ceil(width * share - 1e-9)]
    if not len(seeds):
        return
    covered = np.zeros(len(b), bool)
    for _, *seed in seeds[np.lexsort((seeds[:, 4], seeds[:, 5] - seeds[:, 6]))].tolist():  # the widest first
        if not covered[seed[3]]:
            p = passage_around(a, b, tuple(seed), width, percent, words)
            if p:
                covered[p[2] : p[3] - words + 1] = True
                yield p


def _verified(seeds: DataFrame, docs: DataFrame, words: int, width: int, percent: int, of_one: bool = False) -> DataFrame:
    """Passages of ``seeds`` (a, a_txt, b, b_txt, function, and c, l, r in each) that hold; of pairs whose windows meet in
    two functions, overlapping in both texts by a passage's width, or if so wanted ``of_one``. Columns: _PASSAGE."""
    fields = ("function", "ca", "la", "ra", "cb", "lb", "rb")
    pairs = seeds.groupBy("a", "a_txt", "b", "b_txt").agg(F.collect_set(F.struct(*fields)).alias("seeds"), F.max("rb").alias("n"))
    if not of_one:
        meets = f"least(x.ra, y.ra) - greatest(x.la, y.la) + 1 >= {width} and least(x.rb, y.rb) - greatest(x.lb, y.lb) + 1 >= {width}"
        pairs = pairs.where(f"exists(seeds, x -> exists(seeds, y -> x.function < y.function and {meets}))")
    pairs = common.staged(pairs, "seeds", compression="zstd")
    # a frequent centre's members are dealt into parts, each with the centre's own text; texts join last
    parts = F.broadcast(common.parts_of(pairs, "a_txt", F.col("n"), GROUP_TOKENS))
    count = F.coalesce("parts", F.lit(1).cast("long"))
    members = pairs.join(parts, "a_txt", "left").select("a", "a_txt", F.pmod(F.xxhash64("b_txt"), count).alias("part"), F.lit(1).alias("role"), "b", "b_txt", "seeds")
    nothing = F.array().cast(members.schema["seeds"].dataType).alias("seeds")
    centres = pairs.select("a", "a_txt").distinct().join(parts, "a_txt", "left").select("a", "a_txt", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("b"), F.col("a_txt").alias("b_txt"), nothing)
    texts = common.texts(docs).select(F.col("doc_id").alias("b"), digest_column().alias("b_txt"), "text")
    few = pairs.select("b", "b_txt").unionByName(pairs.select(F.col("a").alias("b"), F.col("a_txt").alias("b_txt")))
    rows = centres.unionByName(members).join(common.split_by(texts, ["b", "b_txt"], few)[0], ["b", "b_txt"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre, ordered, last = None, None, None, None
        for batch in common.slices(batches):
            out: list[tuple] = []
            names = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            own = batch.column(5)
            for k, ((a, a_txt, role, b, b_txt), tokens) in enumerate(zip(names, ngrams_of(batch.column(6).to_pylist(), words), strict=True)):
                if role == 0:
                    key, centre, ordered, last = (a, a_txt), tokens, np.sort(tokens), None
                elif key == (a, a_txt) and (b, b_txt) != last:  # rows that repeat an id and text are neighbours
                    last = b, b_txt
                    table = np.column_stack([own[k].values.field(f).to_numpy() for f in range(7)])
                    out += [(a, a_txt, p[0], p[1], b, b_txt, *p[2:]) for p in pair_passages(centre, ordered, tokens, table, width, percent, words)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    dealt = rows.repartition("a", "a_txt", "part").sortWithinPartitions("a", "a_txt", "part", "role", "b", "b_txt")
    return dealt.select("a", "a_txt", "role", "b", "b_txt", "seeds", "text").mapInArrow(run, _PASSAGE)


def _around_centre(held: DataFrame, hot: DataFrame) -> DataFrame:
    """Seeds of each bucket (key): its other windows against the first window of its least document."""
    joined = common.with_totals(held, "key", hot, m=F.min(F.struct("doc", "txt", "c", "l", "r"))).where(F.col("doc") != F.col("m.doc"))
    return joined.select(F.col("m.doc").alias("a"), F.col("m.txt").alias("a_txt"), F.col("doc").alias("b"), F.col("txt").alias("b_txt"), "function", F.col("m.c").alias("ca"), F.col("m.l").alias("la"), F.col("m.r").alias("ra"), F.col("c").alias("cb"), F.col("l").alias("lb"), F.col("r").alias("rb"))


def _contexts(rest: DataFrame, docs: DataFrame, words: int, width: int) -> DataFrame:
    """``rest`` (key, doc, txt, c, l, r, linked, h, halves) with the window's tokens up to ``reach`` from c, 32 bits of each."""
    reach = max(HELD, 3 * width)
    fields = ("key", "c", "l", "r", "linked", "h", "halves")
    own = rest.groupBy("doc", "txt").agg(F.collect_list(F.struct(*fields)).alias("ws"))
    texts = common.texts(docs).select(F.col("doc_id").alias("doc"), digest_column(), "text")
    rows = texts.join(own, ["doc", "txt"])
    schema = "key long, doc long, txt long, c int, l int, r int, linked boolean, h long, halves long, tokens binary"
    arrow = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 64):
            ws = batch.column(2)
            counts = np.diff(ws.offsets.to_numpy())
            every = ws.flatten()
            c, left, right = (every.field(k).to_numpy() for k in (1, 2, 3))
            first, lengths = np.maximum(left, c - reach), np.minimum(right, c + reach) - np.maximum(left, c - reach) + 1
            # the texts' tokens one after the other, and each window's part of them
            tokens = ngrams_of(batch.column(3).to_pylist(), words)
            starts = np.cumsum([0, *map(len, tokens)])[:-1]
            low = (np.concatenate(tokens) & np.uint64(0xFFFFFFFF)).astype(np.uint32) if tokens else np.zeros(0, np.uint32)
            first = first + np.repeat(starts, counts)
            names = [pa.array(np.repeat(batch.column(k).to_numpy(), counts)) for k in (0, 1)]
            bounds = np.flatnonzero(np.diff(np.cumsum(lengths) // CELL_TOKENS)) + 1  # a batch holds that many tokens
            for k, end in zip([0, *bounds.tolist()], [*bounds.tolist(), len(every)]):
                part = slice(k, end)
                n = lengths[part]
                ends = np.cumsum(n)
                data = low[np.repeat(first[part] - ends + n, n) + np.arange(ends[-1])]
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
                around = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                own = every.slice(k, len(n))
                yield pa.RecordBatch.from_arrays([own.field(0), *(x.slice(k, len(n)) for x in names), *(own.field(f) for f in range(1, 7)), around], schema=arrow)

    return rows.select("doc", "txt", "ws", "text").mapInArrow(run, schema)


def held_tokens(row: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that a window (doc, txt, c, l, r, linked, half, tokens) brings, and those up to 3 widths from its own."""
    tokens, start = np.frombuffer(row[7], np.uint32), max(row[3], row[2] - max(HELD, 3 * width))
    return tokens, tokens[max(row[3], row[2] - 3 * width) - start : row[2] + 3 * width + 1 - start]


def outward(tokens: np.ndarray, at: int) -> list[tuple[np.ndarray, ...]]:
    """To the right from ``at``, then to the left from the token beside it: the different tokens, where each comes
    first, and whether none of the same is nearer on the other side; nearest first."""
    right, left = tokens[at:], tokens[:at][::-1]
    (r, r_at), (l, l_at) = (np.unique(x, return_index=True) for x in (right, left))
    l_at = l_at + 1
    nearer_r, nearer_l = np.ones(len(r), bool), np.ones(len(l), bool)
    both, in_r, in_l = np.intersect1d(r, l, True, True)
    nearer_r[in_r] = r_at[in_r] <= l_at[in_l]
    nearer_l[in_l] = ~nearer_r[in_r]
    return [(x[o], d[o], near[o]) for x, d, near in ((r, r_at, nearer_r), (l, l_at, nearer_l)) for o in (np.argsort(d),)]


class Cell:
    """All pairs of a bucket's windows (doc, txt, c, l, r, linked, half, tokens), sorted, that still matter.

    Windows are joined to components by the passages that are found; those that the centre links are one. A pair
    matters if it lies in two components, or if its greater document has no passage from a lesser one yet.
    Tokens that only one window holds, or only windows whose pairs don't matter, count for nothing, and a window
    that has too few others around its seed for a passage is done; so what is left shrinks as passages are found.
    """

    def __init__(self, rows: list[tuple], width: int, percent: int, words: int):
        self.rows, self.width, self.percent, self.words, self.n = rows, width, percent, words, len(rows)
        docs, linked, half = zip(*((r[0], r[5], r[6]) for r in rows), strict=True)
        self.doc, self.linked, self.half = np.array(docs), np.array(linked), np.array(half)
        self.crosswise = bool(self.half.any() and not self.half.all())
        self.held, self.contexts = zip(*(held_tokens(r, width) for r in rows), strict=True)
        self.starts = np.array([max(r[3], r[2] - 3 * width) for r in rows])
        self.place = np.array([r[2] for r in rows])
        self.at = self.place - self.starts
        self.whole = [len(x) == r[4] - r[3] + 1 for x, r in zip(self.contexts, rows, strict=True)]
        self.full = np.array([len(x) == r[4] - r[3] + 1 for x, r in zip(self.held, rows, strict=True)])
        self.tables: tuple[np.ndarray, ...] = ()
        self.component = np.where(self.linked, self.n, np.arange(self.n))
        self.lesser = self.linked.copy()
        self.failed: set[tuple] = set()
        self.need = shared_least(width, percent)

    def matters(self, a: int | np.ndarray, b: int | np.ndarray) -> np.ndarray:
        possible = (self.doc[a] < self.doc[b]) & ((self.component[a] != self.component[b]) | ~self.lesser[b])
        return possible & (self.half[a] != self.half[b]) if self.crosswise else possible

    def tried(self, a: int, b: int) -> Iterator[tuple]:
        """The seed of this pair and its passage, if there is one; where the tokens around don't reach as far as the
        windows, the seed alone if they or the windows make a passage. What the passage joins is joined."""
        what = (self.masked[a], self.masked[b]) if self.masked else (a, b)
        if what in self.failed:
            return
        x, y = self.contexts[a], self.contexts[b]
        if not self.masked and among(y[max(0, self.at[b] - 2 * self.width) : self.at[b] + 2 * self.width + 1], np.sort(x)).sum() < self.need:
            return  # of few windows, the quickest test first
        seed = (int(self.at[a]), 0, len(x) - 1, int(self.at[b]), 0, len(y) - 1)
        if self.whole[a] and self.whole[b]:  # all that a passage may hold
            p = passage_around(x, y, seed, self.width, self.percent, self.words)
        else:
            near = stretch_near(x, y, seed, self.width, self.percent)
            p = near and passage_of(x, y, seed, *near, self.width, self.percent, self.words)
            if p or near and self._may(a, b, near):
                yield *self.rows[a][:2], *self.rows[b][:2], *self.rows[a][2:5], *self.rows[b][2:5], *(None,) * 6
        if not p:
            self.failed.add(what)
            return
        if self.whole[a] and self.whole[b]:
            places = (int(v + self.starts[k]) for v, k in zip(p[:4], (a, a, b, b), strict=True))
            yield *self.rows[a][:2], *self.rows[b][:2], *self.rows[a][2:5], *self.rows[b][2:5], *places, p[4], [v + int(self.starts[b]) for v in p[5]]
        self._join(a, b)
        self.lesser[b] = True
        # the passage joins the windows of the two texts whose tokens it covers
        for k in self._inside(a, p[0], p[1] - self.words):
            self._join(k, b)
        for k in self._inside(b, p[2], p[3] - self.words):
            self._join(k, b)
            self.lesser[k] = True

    def _may(self, a: int, b: int, failed: tuple) -> bool:
        """Whether the windows make a passage, of which the tokens around made none, or go on beyond what is held of them."""
        if not (self.full[a] and self.full[b]):
            return True
        x, y = self.held[a], self.held[b]
        seed = (self.rows[a][2] - self.rows[a][3], 0, len(x) - 1, self.rows[b][2] - self.rows[b][3], 0, len(y) - 1)
        return passage_around(x, y, seed, self.width, self.percent, self.words, failed) is not None

    def _inside(self, k: int, first: int, last: int) -> range:
        low, high = np.searchsorted(self.doc, self.doc[k], "left"), np.searchsorted(self.doc, self.doc[k], "right")
        return range(*(int(low + np.searchsorted(self.place[low:high], self.starts[k] + v, side)) for v, side in ((first, "left"), (last, "right"))))

    def _join(self, x: int, y: int) -> None:
        own, other = self.component[x], self.component[y]
        if own != other:
            self.component[self.component == own] = other

    masked: list[bytes] = []

    def seeds(self) -> Iterator[tuple]:
        """a, a_txt, b, b_txt, ca, la, ra, cb, lb, rb of pairs that make a passage; then the passage, null if it may be longer."""
        if self.n < 2 or self.linked.all() or self.doc[0] == self.doc[-1]:
            return
        if self.n <= FEW:
            for b in range(self.n):
                for a in range(b):
                    if self.matters(a, b):
                        yield from self.tried(a, b)
            return
        self._index()
        self._prune()
        led = np.zeros(self.n, bool)
        for _ in range(LEADERS):
            left = np.flatnonzero(self.holds & ~led)
            if not len(left):
                return
            leader = int(left[0])
            led[leader] = True
            own = np.zeros(len(self.alive), bool)
            own[self.token[self.owner == leader]] = True
            shared = np.bincount(self.owner[self.near & own[self.token]], minlength=self.n)
            joined = 0
            for b in np.flatnonzero((shared >= self.need) & self.matters(leader, np.arange(self.n))).tolist():
                if self.matters(leader, b):
                    before = self.component[b]
                    yield from self.tried(leader, b)
                    joined += before != self.component[b]
            if joined < FEW:
                break
            self._prune()
        yield from self._all_pairs()

    def _index(self) -> None:
        lengths = np.array([len(x) for x in self.contexts])
        self.owner = np.repeat(np.arange(self.n), lengths)
        kinds, self.token = np.unique(np.concatenate(self.contexts), return_inverse=True)
        distance = np.arange(len(self.owner)) - np.repeat(np.cumsum(lengths) - lengths + self.at, lengths)
        self.near = np.abs(distance) <= 2 * self.width
        index, self.entry = np.unique(self.token << 32 | self.owner, return_inverse=True)
        self.index_token, self.index_owner = index >> 32, index & (1 << 32) - 1
        # where a window holds a token first and last
        position = np.arange(len(self.owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.index_low, self.index_high = np.full(len(index), len(position)), np.zeros(len(index), np.int64)
        np.minimum.at(self.index_low, self.entry, position)
        np.maximum.at(self.index_high, self.entry, position)
        self.first = np.searchsorted(self.index_token, np.arange(len(kinds) + 1))
        several = np.diff(self.first) > 1
        # what two windows' comparison rests on: equal ones fail alike
        flat = np.where(several[self.token], self.token + 1, 0).astype(np.uint32)
        self.masked = [xxhash.xxh64_digest(x.tobytes()) + int(k).to_bytes(4, "little") for x, k in zip(np.split(flat, np.cumsum(lengths)[:-1]), self.at, strict=True)]
        self.alive, self.wanting = several, np.ones(self.n, bool)

    def _prune(self) -> None:
        """Which tokens and windows still matter."""
        starts, own = self.first[:-1], self.index_owner
        component, doc = self.component[own], self.doc[own]
        least = np.minimum.reduceat(doc, starts)
        several = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
        without = np.maximum.reduceat(np.where(self.lesser[own], np.iinfo(np.int64).min, doc), starts) > least
        self.alive = self.alive & (several | without) & (np.maximum.reduceat(doc, starts) > least)
        while True:
            wanting = np.bincount(self.owner[self.near & self.alive[self.token]], minlength=self.n) >= self.need
            alive = self.alive & np.maximum.reduceat(wanting[own], starts)
            same = (wanting == self.wanting).all() and (alive == self.alive).all()
            self.wanting, self.alive = wanting, alive
            if same:
                break
        self.holds = np.zeros(self.n, bool)
        self.holds[own[self.alive[self.index_token]]] = True

    def _all_pairs(self) -> Iterator[tuple]:
        components, ends = 0, np.cumsum(np.bincount(self.owner, minlength=self.n))
        for b in range(self.n):
            if components >= 64:
                self._prune()
                components = 0
            if not self.wanting[b]:
                continue
            part = slice(int(ends[b - 1]) if b else 0, int(ends[b]))
            others = self._sharing(b, part) if self.n > MANY else np.arange(self.n)
            others = others[self.matters(others, b)]
            if len(others):
                others = others[self._dense(b, part, others)]
            if len(others) >= PAYS:
                others = others[self._similar(b, others)]
            while len(others):
                before = self.component[b]
                yield from self.tried(int(others[0]), b)
                others = others[1:]
                if self.component[b] != before or self.lesser[b]:
                    components += self.component[b] != before
                    others = others[self.matters(others, b)]

    def _sharing(self, b: int, part: slice) -> np.ndarray:
        """The windows before b that share enough tokens with it, as far apart in the other window as in a passage."""
        own = np.sort(self.entry[part][self.near[part] & self.alive[self.token[part]]])
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
        own, weights = own[first], np.diff(np.append(first, len(own)))
        places, counts = self._before(own)
        whose = self.index_owner[places]
        shared = np.bincount(whose, np.repeat(weights, counts), self.n)
        enough = np.flatnonzero(shared >= self.need)
        enough = enough[self.matters(enough, b)]
        if not len(enough):
            return enough
        row = np.full(self.n, -1)
        row[enough] = np.arange(len(enough))
        row = row[whose]
        places, row = places[row >= 0], row[row >= 0]
        low, high = np.full(len(enough), 1 << 30), np.zeros(len(enough), np.int64)
        np.minimum.at(low, row, self.index_low[places])
        np.maximum.at(high, row, self.index_high[places])
        return enough[high - low + 1 >= self.width]

    def _before(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each of a window's entries, those of the same token in the windows before it, and how many."""
        low = self.first[self.index_token[own]]
        counts = own - low
        return np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum()), counts

    def _dense(self, b: int, part: slice, others: np.ndarray) -> np.ndarray:
        """``stretch_near`` of b beside each of the ``others``, which come before it, at once: whether it is not None."""
        at, length = int(self.at[b]), len(self.contexts[b])
        first, last = max(0, at - 2 * self.width), min(length - 1, at + 2 * self.width)
        tokens = self.token[part][first : last + 1]
        place = np.flatnonzero(self.alive[tokens])
        entries, counts = self._before(self.entry[part][first : last + 1][place])
        row = np.full(self.n, -1)
        row[others] = np.arange(len(others))
        row = row[self.index_owner[entries]]
        score = np.full((len(others), last - first + 1), -2 * self.percent / (100 - self.percent), np.float32)
        meets = np.flatnonzero(row >= 0)
        score[row[meets], np.repeat(place, counts)[meets]] = 1
        left = np.cumsum(score[:, : at - first + 1][:, ::-1], axis=1)
        right = np.cumsum(score[:, at - first :], axis=1)
        beyond = np.maximum.accumulate(right[:, ::-1], axis=1)[:, ::-1]  # the best end from here on
        least = np.maximum(0, self.width - 1 - np.arange(left.shape[1]))
        within = least < beyond.shape[1]
        return (left[:, within] + beyond[:, least[within]] >= 1 - 1e-3).any(axis=1)


    def _similar(self, b: int, others: np.ndarray) -> np.ndarray:
        """Which of the ``others`` may make a passage with b, all looked at at once.

        On both sides a passage has at least a width of tokens around the window's own, and at most (100 - percent) / percent
        different ones that the other window lacks for each that it has. Those that it has are counted to the right and
        to the left, those that it lacks where they are nearest. Windows that aren't held as a whole, or hold too many
        different tokens, may; a token may pass for another.
        """
        if not self.tables:
            of_tokens = (np.zeros((self.n, OUTWARD), t) for t in (np.uint32, np.uint32, np.int8, np.int8, np.int16))
            self.tables = np.zeros(self.n, np.int8), *of_tokens, np.zeros((self.n, 2), np.int16), np.zeros((self.n, 1 << BITS >> 3), np.uint8)
        state, right, left, right_kind, left_kind, least, counts, bits = self.tables
        for k in (b, *others.tolist()):
            if not state[k]:
                state[k] = self._tabled(k)
        may = np.ones(len(others), bool)
        if state[b] < 0:
            return may
        for some in np.array_split(np.flatnonzero(state[others] > 0), len(others) // 2_048 + 1):
            k, (r, l) = others[some], counts[b]
            has = [bits[k][:, x >> 3] >> (x & 7).astype(np.uint8) & 1 for x in (right[b, :r], left[b, :l])]
            may[some] = self._reaches(has[0], has[1], right_kind[b, :r], left_kind[b, :l], np.broadcast_to(least[b, : l + 1], (len(k), l + 1)))
            some = some[may[some]]
            if len(some):
                k = others[some]
                r, l = counts[k].max(axis=0)
                has = [bits[b, x >> 3] >> (x & 7).astype(np.uint8) & 1 for x in (right[k, :r], left[k, :l])]
                may[some] = self._reaches(has[0], has[1], right_kind[k, :r], left_kind[k, :l], least[k, : l + 1])
        return may

    def _reaches(self, right: np.ndarray, left: np.ndarray, right_kind: np.ndarray, left_kind: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Of rows of tokens to the right and to the left, 1 where the other window has them: whether some are far enough apart and not too few."""
        share = (100 - self.percent) / self.percent
        has, lacks = np.array([0, share, share], np.float32), np.array([0, 0, -1], np.float32)
        ends, begins = (np.cumsum(np.where(x, has[kind], lacks[kind]), axis=1) for x, kind in ((right, right_kind), (left, left_kind)))
        beyond = np.full((len(right), right.shape[1] + 1), -np.inf, np.float32)
        beyond[:, :-1] = np.maximum.accumulate(ends[:, ::-1], axis=1)[:, ::-1]  # the best end from here on
        at = np.take_along_axis(beyond, np.minimum(least, right.shape[1]).astype(np.int64), axis=1)
        at[:, 1:] += begins
        return (at >= -1e-3).any(axis=1)

    def _tabled(self, k: int) -> int:
        """Puts a window's tokens into the tables: 1, or -1 if they aren't all held or are too many. A kind is 0 where there is no
        token, 1 where the same is nearer on the other side, 2 where it is nearest."""
        at = self.rows[k][2] - self.rows[k][3]
        if not self.full[k]:
            return -1
        (r, r_at, r_near), (l, l_at, l_near) = outward(self.held[k], at)
        if len(r) >= OUTWARD or len(l) >= OUTWARD:
            return -1
        _, right, left, right_kind, left_kind, least, counts, bits = self.tables
        r, l = (x & np.uint32((1 << BITS) - 1) for x in (r, l))
        right[k, : len(r)], left[k, : len(l)], counts[k] = r, l, (len(r), len(l))
        right_kind[k, : len(r)], left_kind[k, : len(l)] = 1 + r_near, 1 + l_near
        held = np.zeros(1 << BITS, np.uint8)
        held[r], held[l] = 1, 1
        bits[k] = np.packbits(held, bitorder="little")
        # how far it goes before the next token that is new on its side; the first end that is far enough
        y, x = np.append(r_at[1:] - 1, len(self.held[k]) - 1 - at), np.append(l_at - 1, at)
        first = np.searchsorted(y, self.width - 1 - x)
        least[k] = OUTWARD
        least[k, : len(x)] = np.where(first < len(y), first, OUTWARD)
        return 1


def shared_least(width: int, percent: int) -> int:
    """How many of a passage's tokens that are near its seed the other text has at least."""
    cost = 2 * percent / (100 - percent)
    return int(np.ceil(width * cost / (1 + cost) - 1e-9))


def worth_a_cell(held: list) -> bool:
    """Whether a bucket's windows, as ``Cell`` takes them, are of two documents or more and not all linked."""
    return len(held) > 1 and held[0][0] != held[-1][0] and not all(r[5] for r in held)


def promising(cells: list[list], width: int, percent: int) -> list[bool]:
    """Which of several cells, of CELLS_AT_ONCE windows in all, ``Cell`` may find a pair in; all of them are looked at at once.

    A token counts if windows of two documents hold it, not all of them linked, and one of these windows has a stretch around its
    seed that is a passage if all tokens that count are shared. Cells without such a window have no pair.
    """
    if 4 * width + 2 > 1 << 8:
        return [True] * len(cells)
    rows = [r for held in cells for r in held]
    cell = np.repeat(np.arange(len(cells)), [len(held) for held in cells])
    contexts = [held_tokens(r, width)[1] for r in rows]
    lengths = np.array([len(x) for x in contexts])
    window = np.repeat(np.arange(len(rows)), lengths)
    at = np.array([r[2] - max(r[3], r[2] - 3 * width) for r in rows])
    place = np.arange(len(window)) - np.repeat(np.cumsum(lengths) - lengths + at, lengths) + 2 * width
    place = np.where((place >= 0) & (place <= 4 * width), place, 255)
    # cell, token, window and place in one number: 12, 32, 12 and 8 bits
    order = np.sort(cell[window].astype(np.uint64) << np.uint64(52) | np.concatenate(contexts).astype(np.uint64) << np.uint64(20) | (window << 8 | place).astype(np.uint64))
    inside = np.full((len(rows), 4 * width + 1), -1e6, np.float32)  # no stretch goes beyond a window
    inside[window[place < 255], place[place < 255]] = -2 * percent / (100 - percent)
    kind = order >> np.uint64(20)
    starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    sizes = np.diff(np.append(starts, len(order)))
    window, place = (order >> np.uint64(8) & np.uint64(0xFFF)).astype(np.int64), (order & np.uint64(0xFF)).astype(np.int64)
    doc, wanting = np.array([r[0] for r in rows]), ~np.array([r[5] for r in rows], bool)
    alive = doc[window[starts]] != doc[window[starts + sizes - 1]]  # a cell's windows come by document
    alive &= np.logical_or.reduceat(wanting[window], starts)
    least = np.maximum(0, width - 1 - np.arange(2 * width + 1))
    wanting = np.ones(len(rows), bool)
    while True:
        kept = np.repeat(alive, sizes)
        window, place, sizes = window[kept], place[kept], sizes[alive]
        near = place < 255
        some = np.flatnonzero(wanting & (np.bincount(window[near], minlength=len(rows)) >= shared_least(width, percent)))
        score = inside[some]
        row = np.full(len(rows), -1)
        row[some] = np.arange(len(some))
        near &= row[window] >= 0
        score[row[window[near]], place[near]] = 1
        left, right = np.cumsum(score[:, 2 * width :: -1], axis=1), np.cumsum(score[:, 2 * width :], axis=1)
        beyond = np.maximum.accumulate(right[:, ::-1], axis=1)[:, ::-1]  # the best end from here on
        found = (left + beyond[:, least] >= 1 - 1e-3).any(axis=1)
        before, wanting = wanting.sum(), np.zeros(len(rows), bool)
        wanting[some[found]] = True
        if wanting.sum() == before or not wanting.any():
            break
        alive = np.logical_or.reduceat(wanting[window], np.cumsum(sizes) - sizes)
    return np.isin(np.arange(len(cells)), cell[wanting]).tolist()


def _cell_links(rest: DataFrame, docs: DataFrame, words: int, width: int, percent: int) -> DataFrame:
    """Seeds of all pairs of windows of each bucket of ``rest`` that could join components. Columns as _around_centre,
    and those of a passage, null where the seed has yet to be followed beyond the tokens around it."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("halves") - 1))
    # a window goes to each cell (i, j), i <= j, that its part h belongs to
    dealt = _contexts(rest, docs, words, width).withColumn("o", other)
    cells = dealt.select("key", F.least("h", "o").alias("i"), F.greatest("h", "o").alias("j"), "doc", "txt", "c", "l", "r", "linked", (F.col("h") > F.col("o")).alias("half"), "tokens")
    schema = "a long, a_txt long, b long, b_txt long, ca int, la int, ra int, cb int, lb int, rb int, a_start int, a_end int, b_start int, b_end int, similarity double, cuts array<int>, function long"
    arrow = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full() -> Iterator[list]:
            """Cells, about CELLS_AT_ONCE windows at a time."""
            key, held, some, n = None, [], [], 0
            for batch in batches:
                for k, i, j, *window in zip(*(batch.column(x).to_pylist() for x in range(11)), strict=True):
                    if (k, i, j) != key:
                        if worth_a_cell(held):
                            if n + len(held) > CELLS_AT_ONCE:
                                yield some
                                some, n = [], 0
                            some.append((key, held))
                            n += len(held)
                        key, held = (k, i, j), []
                    if not held or window[:3] != held[-1][:3]:  # rows that repeat an id and text give a window each
                        held.append(window)
            yield some
            if worth_a_cell(held):
                yield [(key, held)]

        for some in full():
            whole = len(some) == 1 and len(some[0][1]) > CELLS_AT_ONCE
            may = [True] if whole else promising([held for _, held in some], width, percent) if some else []
            out = [(*x, key[0] & 7) for (key, held), found in zip(some, may, strict=True) if found for x in Cell(held, width, percent, words).seeds()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc", "txt", "c").mapInArrow(run, schema)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """doc_id and txt of every document, and rep, the least document with the same text."""
    found = common.staged(common.texts(docs.where("doc_id is not null")).select("doc_id", digest_column()), "texts")
    return common.staged(common.with_totals(found, "txt", common.hot_keys(found, "txt"), rep=F.min("doc_id")).distinct(), "reps")


def _sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        txt, words = unpacked(b.column(1).to_pylist(), ("i8", "i4"))
        yield pa.RecordBatch.from_pydict({"txt": txt, "n_words": words})


def _held(docs: DataFrame, reps: DataFrame, words: int, width: int, functions: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The windows that share a key with those of another text (key, doc, txt, c, l, r, function), the frequent keys,
    and n_words of texts (txt) that have windows."""
    with common.scratch(docs.sparkSession):
        found = common.staged(all_windows(docs.where("doc_id is not null"), words, width, functions), "windows", compression="zstd")
        sizes = common.staged(found.where("part is null").mapInArrow(_sizes, "txt long, n_words int").distinct(), "sizes", keep=True)
        shared = shared_windows(found).distinct()
        own = reps.select("txt", F.col("rep").alias("doc")).distinct()
        held = shared.join(own, "txt").select("key", "doc", "txt", "c", "l", "r", F.col("key").bitwiseAND(F.lit(7)).alias("function"))
        held = common.staged(held, "held", keep=True, compression="zstd")
        return held, common.hot_keys(held.select("key", "txt"), "key"), sizes


def repeated_passages(docs: DataFrame, words: int = WORDS, min_words: int = MIN_WORDS, percent: int = PERCENT, functions: int = FUNCTIONS) -> DataFrame:
    """a, a_start, a_end, b, b_start, b_end, similarity: a passage of document b that document a < b has too, in
    word positions (ends exclusive). A copy of a whole text is one passage. Further, the digests a_txt and b_txt of
    the texts that are meant, and ``cuts``, the ends of the runs of b's words that lie in shared tokens.

    Defined cases: a null or empty text, or one of fewer than ``min_words`` words, has no passage; a passage that
    repeats within its own document only is none; rows that repeat an id and text count once, texts that share an
    id are not compared with each other; null ids and other columns are ignored; an empty table gives no rows.
    """
    width = min_words - words + 1
    spark = docs.sparkSession
    reps = distinct_texts(docs)
    held, hot, sizes = _held(docs, reps, words, width, functions)
    with common.scratch(spark):
        first = common.staged(_verified(_around_centre(held, hot), docs, words, width, percent), "passages", keep=True)
    with common.scratch(spark):
        spans = first.groupBy(F.col("a_txt").alias("least_txt"), F.col("b_txt").alias("txt")).agg(F.collect_set(F.struct("b_start", "b_end")).alias("spans"))
        # windows are linked by a passage with the bucket's least document that covers their token
        known = common.with_totals(held, "key", hot, least=F.min(F.struct("doc", "txt")), most=F.max("doc")).where("least.doc < most")
        linked = F.expr(f"doc = least_doc or coalesce(exists(spans, s -> s.b_start <= c and c + {words} <= s.b_end), false)")
        known = known.withColumns({"least_doc": F.col("least.doc"), "least_txt": F.col("least.txt")}).join(spans, ["least_txt", "txt"], "left")
        known = common.staged(known.select("key", "doc", "txt", "c", "l", "r", linked.alias("linked")), "known", compression="zstd")
        size = F.sum(F.expr(f"least(r, c + {3 * width}) - greatest(l, c - {3 * width}) + 1"))
        rest = common.with_totals(known, "key", hot, whole=F.bool_and("linked"), tokens=size).where("not whole")
        rest = rest.withColumn("halves", F.ceil(F.col("tokens") / CELL_TOKENS)).drop("whole", "tokens")
        rest = common.staged(rest.withColumn("h", F.expr("pmod(xxhash64(txt, c), halves)")), "unexplained", compression="zstd")
        seeds = common.staged(_cell_links(rest, docs, words, width, percent), "links", keep=True, compression="zstd")
    second = _verified(seeds.where("cuts is null"), docs, words, width, percent, of_one=True).unionByName(seeds.where("cuts is not null").select(first.columns))
    copies = reps.where(F.col("doc_id") != F.col("rep")).join(sizes.where(F.col("n_words") >= min_words), "txt")
    zero, end, one = F.lit(0).alias("a_start"), F.col("n_words").alias("a_end"), F.lit(1.0).alias("similarity")
    whole = copies.select(F.col("rep").alias("a"), F.col("txt").alias("a_txt"), zero, end, F.col("doc_id").alias("b"), F.col("txt").alias("b_txt"), zero.alias("b_start"), end.alias("b_end"), one, F.array(F.lit(0), "n_words").alias("cuts"))
    return first.unionByName(second).distinct().unionByName(whole)


def passages_by_document(docs: DataFrame, **parameters: int) -> DataFrame:
    """Both sides of every repeated passage: doc_id, start_word, end_word, other_doc_id, similarity."""
    with common.scratch(docs.sparkSession):
        found = common.staged(repeated_passages(docs, **parameters), "found", keep=True)
    b = found.select(F.col("b").alias("doc_id"), F.col("b_start").alias("start_word"), F.col("b_end").alias("end_word"), F.col("a").alias("other_doc_id"), "similarity")
    a = found.select(F.col("a").alias("doc_id"), F.col("a_start").alias("start_word"), F.col("a_end").alias("end_word"), F.col("b").alias("other_doc_id"), "similarity")
    return b.unionByName(a)


def word_starts(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    inside = (b != 32) & ((b < 9) | (b > 13))
    return np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less these word ranges, each with the white space after it."""
    raw = text.encode("utf-8", "replace")
    starts = np.append(word_starts(raw), len(raw))
    keep, at = [], 0
    for first, last in sorted(spans):
        first, last = min(first, len(starts) - 1), min(last, len(starts) - 1)
        keep.append(raw[at : max(at, int(starts[first]))])
        at = max(at, int(starts[last]))
    return b"".join([*keep, raw[at:]]).decode("utf-8", "replace")


def cut_repeats(docs: DataFrame, **parameters: int) -> DataFrame:
    """``docs`` less every word of a repeated passage that a document of a smaller id has too; n_chars follows the text.

    Words of the passage that lie in no shared 5-gram stay. A row loses only what its own text repeats, whatever
    other rows share its id. Rows of which nothing but white space is left go; all other rows, those of a null id
    too, stay, untouched if nothing is cut; the columns are those of ``docs``; an empty table gives no rows.
    """
    with common.scratch(docs.sparkSession):
        found = common.staged(repeated_passages(docs, **parameters), "found", keep=True)
    names = {"b": "__cut_doc", "b_txt": "__cut_txt"}
    cuts = found.groupBy("b", "b_txt").agg(F.collect_set("cuts").alias("__cuts")).withColumnsRenamed(names)
    which = found.select(F.col("b").alias("__doc"), F.col("b_txt").alias("__txt"))
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__doc"), digest.alias("__txt"))
    some, untouched = common.split_by(rows, ["__doc", "__txt"], which)  # most rows stay where they are
    joined = some.join(cuts, (F.col("__doc") == F.col("__cut_doc")) & (F.col("__txt") == F.col("__cut_txt")), "left")
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            row, own = b.column(0), b.column(1).to_pylist()
            spans = [x and [(c[k], c[k + 1]) for c in x for k in range(0, len(c), 2)] for x in own]
            new = [t if s is None else without_spans(t or "", s) for t, s in zip(row.field(at).to_pylist(), spans, strict=True)]
            columns = {f.name: row.field(k) for k, f in enumerate(row.type)}
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if s is None else len(t) for n, t, s in zip(columns["n_chars"].to_pylist(), new, spans, strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array([s is None or bool(t.strip()) for t, s in zip(new, spans, strict=True)], pa.bool_()))

    return untouched.select("__row.*").unionByName(joined.select("__row", "__cuts").mapInArrow(run, docs.schema))
