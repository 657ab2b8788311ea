import random
import re
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tidelog.llm import compact_windows, graph, prefix_forest, set_join
from tidelog.llm.common import staged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig long, cls long, component string, a int"


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), 1, 2, "c", 3) for k, t in texts], SCHEMA)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(draw, n):
    return [f"w{draw.randint(0, 3000)}" for _ in range(n)]


def edited(draw, words, edits):
    out = list(words)
    for _ in range(edits):
        out[draw.randrange(len(out))] = f"e{draw.randint(0, 10**6)}"
    return out


def near_copies(draw):
    """Groups of near copies of all sizes and distances, chains, tiny and repeated texts."""
    texts = [None, "", " \t\n", "one", "One", "one two", "one two three", "ONE two\x0bthree", "x " * 400, "x " * 400, "ÄÖ äö ß", "äÖ äö ß"]
    for size in (4, 8, 12, 20, 40, 90, 200, 500):
        for _ in range(4):
            base = prose(draw, size)
            texts += [" ".join(base)] + [" ".join(edited(draw, base, draw.randint(0, max(1, size // 30)))) for _ in range(6)]
            chain = base
            for _ in range(4):
                chain = edited(draw, chain, max(1, size // 100))
                texts.append("\n".join(chain))
    draw.shuffle(texts)
    return texts


def brute_components(docs, n, percent):
    sets = {}
    for k, t in docs:
        w = words_of(t)
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize(("words", "percent", "held"), [(3, 90, 400_000), (5, 80, 400_000), (3, 90, 1_500)])
def test_op10_equals_brute_force(spark, monkeypatch, words, percent, held):
    monkeypatch.setattr(set_join, "GROUP_NGRAMS", held)  # 1,500: groups and cells are split
    docs = list(enumerate(near_copies(random.Random(percent)), 100))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in set_join.jaccard_components(documents(spark, docs), words, percent).collect()}
    assert got == brute_components(docs, words, percent)


def test_op10_rows_and_empty_tables(spark):
    df = documents(spark, [(5, "a b c d"), (5, "a b c d"), (7, "A b c d"), (8, None)])
    assert sorted(map(tuple, set_join.jaccard_components(df).collect())) == [(5, 2, 5), (5, 2, 5), (7, 2, 5), (8, 0, 8)]
    kept = set_join.keep_one_of_each(df, 3, 90)
    assert sorted(r.doc_id for r in kept.collect()) == [5, 8] and kept.columns == df.columns
    assert set_join.jaccard_components(df.limit(0)).count() == 0


def test_pigeonhole_allotments():
    for percent in (80, 90):
        for documents_ in (10, 10**6, 10**11):
            bands = set_join.Bands(percent, documents_)
            for band in range(20):
                segments, deleting, spare = bands.allotment(band)
                high = bands._edge(band + 1) - 1
                assert 0 <= deleting <= segments and segments + deleting == (100 - percent) * 2 * high // (100 + percent) + 1 + spare
    assert any(set_join.Bands(90, 10**11).allotment(b)[1] for b in range(20))
    draw = np.random.default_rng(1)
    for documents_ in (10, 10**11):  # sets that differ by one n-gram less than the bound always share a signature
        bands = set_join.Bands(80, documents_)
        for n in range(1, 200, 7):
            a = draw.integers(0, 1 << 62, n).astype(np.uint64)
            common = n - n // 10
            b = np.concatenate([a[:common], draw.integers(0, 1 << 62, n // 10).astype(np.uint64)])
            if set_join.similar(np.unique(a), np.unique(b), 80):
                assert np.intersect1d(bands.signatures(np.unique(a)), bands.signatures(np.unique(b))).size


def test_compatible_pairs_connect_what_sketches_allow():
    draw = np.random.default_rng(7)
    sets, base = [], [np.unique(draw.integers(0, 1 << 62, 150)).astype(np.uint64) for _ in range(12)]
    for k in range(120):
        b = base[k % 12]
        sets.append(np.unique(np.concatenate([b[: len(b) - k // 5], draw.integers(0, 1 << 62, k // 6).astype(np.uint64)])))
    rows = np.frombuffer(b"".join(map(set_join.sketch, sets)), np.uint8).reshape(120, -1)
    cls, none = np.arange(120) + 1000, np.zeros(120, bool)
    for component in (np.arange(120), np.where(np.arange(120) % 12 < 6, 0, np.arange(120))):
        for half in (none, np.arange(120) % 2 == 1):
            found = set_join.compatible_pairs(cls, component, half, rows, 80)
            parent = {int(c): int(c) for c in cls}

            def find(x, parent=parent):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in found:
                parent[find(a)] = find(b)
            for a, b in combinations(range(120), 2):
                if component[a] != component[b] and (half[a] != half[b] or not half.any()):
                    if set_join.similar(sets[a], sets[b], 80):
                        assert find(1000 + a) == find(1000 + b)
    assert len(set_join.compatible_pairs(cls, np.arange(120), none, rows, 80)) < 120


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 30)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    for one_task in (0, 1000):
        got = {r.node: r.component for r in graph.components(edges, one_task).collect()}
        assert got == {k: 0 for k in range(31)} | {90: 90, 95: 90, 100: 90}
        assert graph.components(edges.limit(0), one_task).count() == 0


def test_cartesian_windows_equal_brute_force():
    draw = np.random.default_rng(3)
    for n in (1, 5, 40, 200):
        h = draw.integers(1, 20, n).astype(np.uint64)
        found = compact_windows.windows(np.concatenate([[0], h, [0]]).astype(np.uint64), 3) - 1
        for i in range(n):
            for j in range(i + 2, n):
                assert sorted(c for left, c, r in found.tolist() if left <= i <= c <= j <= r) == (np.flatnonzero(h[i : j + 1] == h[i : j + 1].min()) + i).tolist()
    # inside a periodic run the first and last stay
    tokens = np.array([0, 7, 8, 9, *[5, 6] * 10, 3, 7, 8, 9, 0], np.uint64)
    found = compact_windows.windows(np.where(tokens > 0, tokens, 0), 8, tokens).tolist()
    assert found == [[1, 24, 27], [1, 4, 23], [1, 22, 23]] or sorted(found) == [[1, 4, 23], [1, 22, 23], [1, 24, 27]]


def test_op8_planted_passages(spark):
    draw = random.Random(8)
    passage, line = prose(draw, 60), prose(draw, 18)
    texts = {}
    for k in range(40):
        own = prose(draw, draw.randint(60, 300))
        if k % 4 == 0:
            at = draw.randrange(len(own))
            own[at:at] = passage if k % 8 == 0 else edited(draw, passage, 1)
        if k % 2:
            own[10:10] = line
        texts[k] = " ".join(own)
    texts |= {50: None, 51: "", 52: " ".join(passage[:30]), 53: "y " * 300, 60: texts[1], 61: texts[1]}
    df = documents(spark, list(texts.items()))
    rows = compact_windows.passages_by_document(df).collect()
    covered = {}
    for r in rows:
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert r.similarity >= 0.8 and r.end_word - r.start_word >= 50 and r.doc_id != r.other_doc_id
    assert set(covered) == {k for k in range(40) if k % 4 == 0} | {1, 60, 61}
    for k in range(0, 40, 8):
        at = words_of(texts[k]).index(passage[0])
        assert set(range(at, at + 60)) <= covered[k] and len(covered[k]) <= 70
    cut = {r.doc_id: r for r in compact_windows.cut_repeats(df).collect()}
    assert cut[0].text == texts[0] and cut[3].text == texts[3] and cut[52].text == texts[52] and cut[53].text == texts[53] and 60 not in cut and 50 in cut
    assert not set(passage) <= set(words_of(cut[8].text)) and cut[8].n_chars == len(cut[8].text)
    assert compact_windows.passages_by_document(df.limit(0)).count() == 0 and compact_windows.cut_repeats(df).columns == df.columns


def test_op8_around_a_frequent_line(spark):
    """One line in every document makes large buckets; pairs of passages around it are found all the same."""
    draw = random.Random(9)
    line = prose(draw, 30)
    texts = []
    for k in range(60):
        around = prose(draw, 20) + line + prose(draw, 20)
        texts += [(2 * k, " ".join(prose(draw, 50) + around + prose(draw, 50))), (2 * k + 1, " ".join(prose(draw, 80) + around + prose(draw, 20)))]
    pairs = {(r.a, r.b) for r in compact_windows.repeated_passages(documents(spark, texts)).collect()}
    assert len({(2 * k, 2 * k + 1) for k in range(60)} & pairs) >= 57 and all(a // 2 == b // 2 for a, b in pairs)


def pairs_found(spark, texts):
    """Pairs (a, b) of which a passage is found; documents are named 10 * group + place."""
    return {(r.a, r.b) for r in compact_windows.repeated_passages(documents(spark, texts)).collect()}


def test_op8_beside_an_edited_copy(spark):
    """The least document of each bucket holds an edited version; the two others share the passage exactly."""
    draw = random.Random(21)
    texts = []
    for k in range(60):
        passage = prose(draw, 60)
        far = [f"e{draw.randint(0, 10**6)}" if i % 14 == 7 else w for i, w in enumerate(passage)]
        texts += [(10 * k + j, " ".join(prose(draw, 40) + p + prose(draw, 40))) for j, p in enumerate((far, passage, passage))]
    pairs = pairs_found(spark, texts)
    assert {(10 * k + 1, 10 * k + 2) for k in range(60)} <= pairs and all(a // 10 == b // 10 for a, b in pairs)


def test_op8_cells(monkeypatch):
    """Cells give a seed for every linked pair of a bucket, however tokens are counted."""
    draw = np.random.default_rng(22)
    line, groups = draw.integers(0, 1 << 32, 20), [draw.integers(0, 1 << 32, 40) for _ in range(30)]
    rows = []
    for doc in range(90):
        tokens = np.concatenate([draw.integers(0, 1 << 32, 20), groups[doc % 30][:20], line, groups[doc % 30][20:], draw.integers(0, 1 << 32, 15)])
        rows.append((doc, -doc, 45, 0, len(tokens) - 1, False, False, tokens.astype(np.uint32).tobytes()))

    def pairs(rows):
        return {(a, b) for a, _, b, *_ in compact_windows.Cell(rows, 46, 80, 5).seeds()}

    for few, many, leaders in ((6, 64, 8), (100, 64, 0), (2, 64, 0), (2, 64, 50), (2, 2, 0), (2, 200, 8)):
        monkeypatch.setattr(compact_windows, "FEW", few)
        monkeypatch.setattr(compact_windows, "MANY", many)
        monkeypatch.setattr(compact_windows, "LEADERS", leaders)
        assert pairs(rows) == {(k, k + 30 * j) for k in range(30) for j in (1, 2)}
    # windows that the centre links are left out, halves meet crosswise
    linked = [(*r[:5], r[0] % 30 == 0, *r[6:]) for r in rows]
    assert pairs(linked) == {(k, k + 30 * j) for k in range(1, 30) for j in (1, 2)}
    halves = [(*r[:6], r[0] >= 60, r[7]) for r in rows]
    assert pairs(halves) >= {(k, k + 60) for k in range(30)}


def test_op8_pair_that_meets_in_one_function(spark):
    """Edited passages of two documents only: the bucket of one function is enough; one pair in 625 shares none."""
    draw = random.Random(23)
    texts = []
    for k in range(200):
        passage = prose(draw, 50)
        other = [*passage[:25], f"e{k}", *passage[26:]]
        texts += [(10 * k + j, " ".join(prose(draw, 40) + p + prose(draw, 40))) for j, p in ((1, passage), (2, other))]
    pairs = pairs_found(spark, texts)
    assert len({(10 * k + 1, 10 * k + 2) for k in range(200)} & pairs) >= 199 and all(a // 10 == b // 10 for a, b in pairs)


def test_op8_all_pairs_around_frequent_lines(spark):
    """60 of 60 pairs, whichever functions tell them apart."""
    for size in (30, 40):
        draw = random.Random(9)
        line = prose(draw, size)
        texts = []
        for k in range(60):
            around = prose(draw, 35 - size // 2) + line + prose(draw, 35 - size // 2)
            texts += [(10 * k + 1, " ".join(prose(draw, 50) + around + prose(draw, 50))), (10 * k + 2, " ".join(prose(draw, 80) + around + prose(draw, 20)))]
        pairs = pairs_found(spark, texts)
        assert {(10 * k + 1, 10 * k + 2) for k in range(60)} <= pairs and all(a // 10 == b // 10 for a, b in pairs)


def test_op8_least_document_quotes_itself(spark):
    """The least document holds a large part of the passage a second time, earlier."""
    draw = random.Random(24)
    texts = []
    for k in range(60):
        passage = prose(draw, 60)
        texts += [(10 * k + 1, " ".join(prose(draw, 40) + passage[:48] + prose(draw, 60) + passage + prose(draw, 40))), (10 * k + 2, " ".join(prose(draw, 40) + passage + prose(draw, 40)))]
    pairs = pairs_found(spark, texts)
    assert {(10 * k + 1, 10 * k + 2) for k in range(60)} <= pairs and all(a // 10 == b // 10 for a, b in pairs)


def test_cut_repeats_by_text(spark):
    """Rows that share an id lose what their own text repeats only, and words that the other text lacks stay."""
    draw = random.Random(31)
    passage = prose(draw, 60)
    own = [[f"own{k}_{i}" for i in range(100)] for k in range(4)]
    changed = [*passage[:30], "EDIT", *passage[31:]]
    rows = [(1, " ".join(own[0][:40] + passage + own[0][40:])), (2, " ".join(own[1][:40] + passage + own[1][40:])), (2, " ".join(own[2])), (3, " ".join(own[3][:50] + changed + own[3][50:]))]
    cut = sorted((r.doc_id, r.text) for r in compact_windows.cut_repeats(documents(spark, rows)).collect())
    assert [t for k, t in cut if k == 1] == [rows[0][1]]
    assert {t for k, t in cut if k == 2} == {" ".join(own[1]), " ".join(own[2])}
    left = next(t for k, t in cut if k == 3).split()
    assert [w for w in left if w.startswith("own")] == own[3] and "EDIT" in left and len(left) <= 102


def test_op8_recall_against_brute_force(spark):
    """Of pairs of passages at similarities from 0.8 on, by all pairs of stretches; a pair in 625 may be missed at 0.8."""
    draw = random.Random(32)
    texts, wanted = [], {}
    for k in range(150):
        passage = prose(draw, draw.randint(50, 140))
        other = list(passage)
        for i in draw.sample(range(5, len(passage) - 5), draw.randint(0, len(passage) // 50)):
            other[i] = f"e{k}_{i}"
        grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (passage, other)]
        similarity = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
        if similarity >= 0.8:
            wanted[10 * k + 1, 10 * k + 2] = similarity
        texts += [(10 * k + j, " ".join(prose(draw, 60) + p + prose(draw, 60))) for j, p in ((1, passage), (2, other))]
    pairs = pairs_found(spark, texts)
    assert len(wanted) > 100 and min(wanted.values()) < 0.83 and max(wanted.values()) == 1.0
    assert len(set(wanted) - pairs) <= 1 and all(a // 10 == b // 10 for a, b in pairs)


def test_without_spans():
    assert compact_windows.without_spans("a b  c\nd e", [(1, 3)]) == "a d e" and compact_windows.without_spans(" a b", [(0, 2)]) == " " and compact_windows.without_spans("é b c", [(0, 1), (0, 2)]) == "c"


def test_op9_against_brute_force(spark):
    draw = np.random.default_rng(4)
    x = draw.standard_normal((3000, 16))
    x[::7] = x[3]  # a very common vector
    rows = [(k, v.tolist(), 0, 1) for k, v in enumerate(x)]
    rows += [(5000, None, 0, 1), (5100, [], 0, 1), (5200, [0.0] * 16, 0, 1), (5300, [1.0] * 15 + [None], 0, 1), (5400, [float("nan")] * 16, 0, 1), (None, [1.0] * 16, 0, 1), (7000, [1.0, 2.0], 0, 1), (7001, [1.0, 2.5], 0, 1), rows[100]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score int")
    out = prefix_forest.nearest_neighbours(df, block=1000).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    assert set(got) == {*range(0, 3000, 100), 7000} and [v for _, v in got[7000]] == [7001]
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [(float(d[k]), int(k)) for k in np.lexsort((np.arange(3000), d)) if k != q][:10]
        hits += len({v for _, v in want} & {v for _, v in got[q]})
        assert got[q] == sorted(got[q]) and all(abs(s - d[v]) < 1e-12 for s, v in got[q])
    assert hits >= 0.9 * 300
    assert prefix_forest.nearest_neighbours(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [3_000, 8_000])
def test_op9_finds_nine_of_ten_among_a_tenth(n):
    """Isotropic vectors, the hard case: recall against brute force, and the share of a block that is looked at."""
    draw = np.random.default_rng(n)
    x = draw.standard_normal((n, 64))
    queries, hits, looked_at = x[:60], 0, 0
    forest = prefix_forest.PrefixForest(x)
    for found in forest.candidates(queries, int(prefix_forest.SHARE * n)):
        looked_at += len(found)
    for q, (entries, d) in zip(queries, forest.nearest(queries, 11), strict=True):
        true = np.sqrt(((x - q) ** 2).sum(1))
        hits += len(set(entries[:11].tolist()) & set(np.argsort(true, kind="stable")[:11].tolist()))
        assert (np.diff(d) >= 0).all() and np.allclose(d, true[entries])
    assert hits >= 0.9 * 60 * 11 and looked_at <= 0.12 * 60 * n
    # with the trees' entries mixed up, candidates are found by chance
    lost = prefix_forest.PrefixForest.__new__(prefix_forest.PrefixForest)
    lost.__dict__.update(forest.__dict__, order=draw.permutation(len(forest.order)) % n)
    wrong = sum(len(set(e[:11].tolist()) & set(np.argsort(((x - q) ** 2).sum(1))[:11].tolist())) for q, (e, _) in zip(queries, lost.nearest(queries, 11), strict=True))
    assert wrong < 0.5 * 60 * 11


ODD = "doc_id long, text string, lang string, source string, n_chars long, __row string, __cuts int, __again int, __txt long, sig long"


def test_pipeline_stages_on_odd_documents(spark):
    """Nulls, empty and long texts, repeated rows and ids, columns with clashing names, in every stage; and empty tables."""
    sf, draw = "/root/testdata/sf0.001", random.Random(33)
    some = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and length(text) > 400").orderBy("doc_id").limit(6).collect()]
    rows = [(900 + k, t) for k, t in enumerate(some)]
    rows += [(None, None), (None, some[0]), (None, some[0]), (910, None), (911, ""), (912, " \n"), (913, "\n".join(some) * 40), (900, some[0]), (901, some[2]), (914, some[3]), (915, some[4] + " more"), (916, "12 34")]
    docs = spark.createDataFrame([(k, t, None, None, len(t or ""), "x", 1, 2, 3, 4) for k, t in rows], ODD)
    both = docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet"), allowMissingColumns=True)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, both, sf)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and {900, 901, 913, None} <= ids and not {910, 911, 912, 916} & ids
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() >= docs.count() - 3
    single = stages["near copies"](spark, docs, sf).collect()
    found = sorted((r.doc_id, r.text or "") for r in single if r.doc_id is not None)
    assert [k for k, _ in found].count(900) == 1 and 914 not in dict(found) and 915 not in dict(found) and {910, 911, 912, 913} <= set(dict(found))
    assert sorted(r.text or "" for r in single if r.doc_id is None) == ["", some[0]]
    cut = stages["repeated passages"](spark, docs, sf)
    texts = {}
    for r in cut.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert cut.columns == docs.columns and texts[900] == [some[0]] * 2 and 902 not in texts and 914 not in texts and len(texts[913][0]) < 0.1 * len(rows[12][1]) if 913 in texts else True
    packed = stages["packing"](spark, docs, sf).collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0) and len([r for r in packed if r.start == 0]) == docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_pipeline_stages_act(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near copies", "repeated passages", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = staged(stage(spark, before, sf), "test")
        assert after.columns == docs.columns and 0.5 * before.count() < after.count() <= before.count(), name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert packed.select("doc_id").distinct().count() == before.count()
