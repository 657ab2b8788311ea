import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidelog.llm import bpe_automaton, iso_media, language, packing, queries, site_templates, token_files, toxicity
from tidelog.llm.tokens import PieceTokenizer, public_path

ODD = ["Hello's I'LL  don't\n\n x\x1cy ²³½ ABC_9 <|endoftext|> b", "日本 Σας ΣΑΣ", "a<b <|x", "  ", "İstanbul ŉa", "   x  \x85y", "naïve café´s — ok", "aaaaaaaaaaaa bananana", "!!!!!!!!!!", "a\n b\tc", "x" * 3000, "word " * 5000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, start long, n long"


def documents(spark, texts):
    return spark.createDataFrame([(k, t, None, None, None, 0.5, 7, 7) for k, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, [(3, None), (4, ""), (9, "same"), (9, "same"), *((20 + k, t) for k, t in enumerate(ODD))])


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoders_equal_the_library(name):
    library, pieces, automaton = Tokenizer.from_file(public_path(name)), PieceTokenizer(public_path(name), max_remembered=50), bpe_automaton.AutomatonTokenizer(public_path(name))
    draw = random.Random(5)
    texts = ["", *ODD, *("".join(draw.choice("abehtnsro ,.'\n1") for _ in range(80)) for _ in range(100)), *("".join(draw.choice("aab") for _ in range(30)) for _ in range(100))]
    for text, ids in zip(texts, pieces.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert automaton.encode(text) == want
        assert automaton.encode_and_decode(text)[0] == " ".join(map(str, want))


def test_automaton_of_a_toy_vocabulary():
    # a, b, aa, aab: "aaab" is a aab by the merges' order, not aa ab
    a = bpe_automaton.MergeAutomaton([(0, 0, 2), (2, 1, 3)], 4)
    assert not a.has_arc(a.target[0], 0) and a.has_arc(a.target[2], 0) and not a.has_arc(a.target[2], 1) and not a.has_arc(a.target[0], 2)


def test_op4(spark, odd, empty):
    path = public_path(queries.WORD_BPE)
    library = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    rows = bpe_automaton.tokenization_digests(odd, path).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert bpe_automaton.tokenization_digests(empty, path).count() == 0


def test_variable_length_codes():
    draw = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (draw.integers(0, 1 << 32, n) >> draw.integers(0, 32, n)).astype(np.uint32)
        control, data = token_files.encode_ranks(values)
        assert len(control) == -(-n // 4)
        assert (token_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == values).all()


@pytest.mark.parametrize("file_ids", [50, 1 << 20])
def test_op3(spark, odd, empty, file_ids):
    path = public_path(queries.WORD_BPE)
    library = Tokenizer.from_file(path)
    files = token_files.write_token_files(odd, path, file_ids=file_ids)
    rows = sorted(token_files.read_token_files(files).collect())
    docs = sorted((r.doc_id, r.text or "") for r in odd.collect())
    at = 0
    for r, (doc, text) in zip(rows, docs, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert tuple(r) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_file_digests(empty, path).count() == 0


def test_op5(spark, odd, empty):
    path = public_path(queries.BYTE_BPE)
    library = Tokenizer.from_file(path)
    unique = odd.where("doc_id <> 9")
    rows = packing.packed_sequences(unique, path).collect()
    for doc in unique.collect():
        ids, at = [*library.encode(doc.text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted((r for r in rows if r.doc_id == doc.doc_id), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    assert packing.packed_sequences(odd, path).where("doc_id = 9 and start = 0").count() == 2
    assert packing.packed_sequences(empty, path).count() == 0


def test_sum_of_squares_rule_and_windows():
    draw = random.Random(2)
    packer = packing.SumOfSquares(64)
    for k in range(2000):
        size = draw.choice([draw.randint(1, 63), 20, 44])
        counts = packer.counts.copy()

        def squares(level, size=size, counts=counts):
            c = counts.copy()
            c[level] -= level > 0
            c[level + size] += level + size < 64
            return int((c**2).sum())

        allowed = [h for h in range(0, 64 - size + 1) if h == 0 or counts[h]]
        assert squares(packer.level_for(size)) == min(map(squares, allowed))
        packer.place((k, 0, np.zeros(size, np.uint16), size))
    docs = [(k, np.arange(draw.randint(1, 300), dtype=np.uint16)) for k in range(300)]
    rows = list(packing.pack(docs, 64))
    fills = {}
    for r in rows:
        assert r[6] == fills.get(r[5], 0)
        fills[r[5]] = r[6] + r[2]
    assert all(f == 64 or f & (f - 1) == 0 for f in fills.values()) and sum(fills.values()) == sum(len(x) for _, x in docs)


def test_iso_media_round_trip_and_tables():
    for n in (192, 192 * 25, 192 * 26, 192 * 60):
        payload = bytes(range(256)) * (n // 256 + 1)
        data = iso_media.write_raw_video(payload[:n])
        (track,) = iso_media.probe(data)
        assert track.payload(data) == payload[:n]
        assert (track.codec, track.timescale, track.duration, len(track.sizes)) == ("raw ", 25, n // 192, n // 192)
        assert all(data[a : a + 192] == payload[192 * 25 * k :][:192] for k, (a, _) in enumerate(track.keyframe_ranges()))
    for broken in (data[:-10], data[:100], data.replace(b"stsz", b"free"), b"\x00\x00\x00\x04moov"):
        with pytest.raises(iso_media.MediaError):
            if not iso_media.probe(broken):
                raise iso_media.MediaError("no track")
    with pytest.raises(iso_media.MediaError):
        iso_media.write_raw_video(b"x")


def test_iso_media_other_layouts():
    """64-bit boxes, varying sizes, two samples a chunk, no stss: all samples are keyframes."""
    import struct

    b, f = iso_media.box, iso_media.full_box
    payload = b"abcdefghij"
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload
    stbl = b(b"stbl", f(b"stsd", struct.pack(">I", 1), b(b"avc1", bytes(78))), f(b"stts", struct.pack(">IIIII", 2, 2, 10, 2, 20)), f(b"stsc", struct.pack(">IIII", 1, 1, 2, 1)), f(b"stsz", struct.pack(">IIIIII", 0, 4, 1, 2, 3, 4)), f(b"co64", struct.pack(">IQQ", 2, 16, 19)))
    mdia = b(b"mdia", f(b"mdhd", struct.pack(">QQIQI", 0, 0, 1000, 60, 0), version=1), b(b"minf", stbl))
    (t,) = iso_media.probe(mdat + b(b"moov", b(b"trak", mdia)))
    assert (t.codec, t.timescale, t.duration) == ("avc1", 1000, 60)
    assert t.keyframe_ranges() == [(16, 1), (17, 2), (19, 3), (22, 4)] and t.payload(mdat) == payload


def test_op6(spark, odd, empty):
    rows = iso_media.media_digests(iso_media.store_media(odd)).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.feature.startswith("codec=raw;timescale=25;")
    assert len({tuple(r)[1:] for r in rows if r.doc_id == 9}) == 1
    assert iso_media.media_digests(iso_media.store_media(empty)).count() == 0


def test_op1(spark, empty):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for k in range(1200):
        toxic = k % 5 == 0
        words = [word() for _ in range(30)] + (["scumbag", "scumble"] if toxic else [])
        draw.shuffle(words)
        rows.append((k, " ".join(words)))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, 1, int(toxic)))
    labels += [(None, 1, 1), (99999, 0, None)]
    docs = documents(spark, [*rows, (5000, None), (5001, "")])
    named = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, toxicity.train(docs, named)).collect()}
    assert len(got) == 1202
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out for k in held) and sum(r.held_out for r in got.values() if r.doc_id < 5000) == len(held)
    assert sum(got[k].predicted == (k % 5 == 0) for k in held) >= 0.98 * len(held)
    assert got[5000].score == got[5001].score < 0.3
    assert toxicity.scored(empty, toxicity.train(empty, named)).count() == 0
    alone = toxicity.train(docs, named.limit(0))
    assert {r.predicted for r in toxicity.scored(docs, alone).collect()} == {0}
    assert set(toxicity.keep_clean(docs, toxicity.train(docs, named)).columns) == set(docs.columns)


def test_nnpu_corrects_for_the_prior():
    draw = random.Random(4)
    features = [*(f"1{k}" for k in range(6)), "1bad", "1worse"]
    make = lambda toxic: np.array([draw.randint(0, 5)] + ([6, 7] if toxic else []))
    model = toxicity.fit_nnpu([make(True) for _ in range(200)], [make(draw.random() < 0.3) for _ in range(2000)], features, 0.3)
    z = lambda *f: model.bias + sum(model.weights.get(x, 0) for x in f)
    assert toxicity.sigmoid(z("1bad", "1worse")) > 0.8 and toxicity.sigmoid(z("12")) < 0.2


def test_op7(spark, empty):
    draw = random.Random(6)
    syllables = {"xx": "ka lo mi ra to ne su ri".split(), "yy": "sch ung heit ver ein gen ich ab".split(), "zz": "eau oux tion pre elle que ai dans".split()}
    rows = []
    for k in range(300):
        lang = list(syllables)[k % 3]
        rows.append((k, " ".join("".join(draw.choice(syllables[lang]) for _ in range(draw.randint(1, 4))) for _ in range(40)), lang if k % 4 else None, None, None, 0.0, 0, 0))
    rows += [(900 + k, t, "xx", None, None, 0.0, 0, 0) for k, t in enumerate([None, "", "123 !!", "kalo " * 20000])]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.train(docs)
    got = {r.doc_id: r for r in language.identified(docs, model).collect()}
    assert len(got) == 304 and all(got[k].lang_pred == list(syllables)[k % 3] and 0.5 < got[k].score <= 1 for k in range(300))
    assert [got[900 + k].lang_pred for k in range(4)] == ["und", "und", "und", "xx"] and got[901].score == 0
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(300))
    kept = {r.doc_id for r in language.keep_identified(docs, model).collect()}
    assert kept >= set(range(300)) and not kept & {900, 901, 902}
    assert language.identified(empty, language.train(empty)).count() == 0
    assert {r.lang_pred for r in language.identified(docs, language.train(empty)).collect()} == {"und"}


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href=/a>Menu</a></li></ul></nav>
<div class=box>Every page has this box</div><script>var x="</p>";</script><article><h1>Title {k}</h1><p><b>First&nbsp;&amp; {k}<br><p>Second
   paragraph</p><div class="share-buttons">Share</div><p>Same everywhere</p><form><input>Send</form></article>
<aside>side</aside><!-- c --><div id="comments"><p>Reader {k}</p></div><footer>&copy; host</footer></body></html>"""


@pytest.mark.parametrize("large", [4_000, 3])
def test_op2(spark, monkeypatch, large):
    monkeypatch.setattr(site_templates, "HOST_PAGES", large)  # 3: hosts are dealt into parts
    pages = [(k, "http://A.example/x", PAGE.format(k=k), 1) for k in range(12)]
    pages += [(50 + k, "http://B.example/", f"<body><div>Box of the site</div><div><p>Text {k}<p>More &lt;{k}&gt;</div></body>", 1) for k in range(8)]
    pages += [(90, None, None, 1), (91, "nonsense", "", 1), (92, "http://c.example", "plain <b>text</b> only", 1), (93, "http://d.example", "<article><p>open", 1), (93, "http://d.example", "<article><p>open", 1), (94, "http://e.example", "<p>a" + " b" * 50000, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text long")
    got = {r.page_id: r for r in site_templates.main_texts(df).collect()}
    assert got[3].text == "Title 3\nFirst & 3\nSecond paragraph\nSame everywhere" and got[3].url == "http://A.example/x"
    assert got[52].text == "Text 2\nMore <2>"
    assert [got[k].text for k in (90, 91, 92, 93)] == ["", "", "plain text only", "open"] and got[90].n_chars == 0 and got[94].n_chars == 100001
    assert site_templates.main_texts(df).count() == len(pages) and site_templates.main_texts(df.limit(0)).count() == 0


def site(k):
    return f'<html><head><title>T {k}</title></head><body><nav><ul>{"".join(f"<li><a>L{k * 7 + i}</a>" for i in range(3 + k % 4))}</ul></nav><div class="ad">Buy {k} now</div><div id="legal">Terms {k}</div><article><h1>Head {k}</h1><p>{"word " * 30}{k}</p><p>Same on all</p></article><footer>Foot {k}</footer></body></html>'


def test_op2_templates_decide(spark):
    """No subtree of this site recurs with its texts; menus, adverts and footers recur by structure, and only that removes them."""
    pages = [(k, "http://a.example/x", site(k)) for k in range(9)]
    got = {r.page_id: r.text for r in site_templates.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k, _, source in pages:
        want = f"Head {k}\n{'word ' * 30}{k}\nSame on all"
        assert got[k] == want
        without = site_templates.main_text(source, site_templates.Template(9, set()))
        assert without != want and f"Buy {k} now" in without and f"Foot {k}" in without and f"Terms {k}" in without
    # a host of few pages has its tags and classes
    assert site_templates.main_text(site(1), site_templates.Template(1, set())) == f"Head 1\n{'word ' * 30}1\nSame on all"


def test_op2_templates_decide_on_the_pages_table(spark):
    """Removal changes every page of a host whose pages can be counted."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    named = pages.select("page_id", "html", site_templates.host("url").alias("host")).collect()
    sizes = {}
    for r in named:
        sizes[r.host] = sizes.get(r.host, 0) + 1
    got = {r.page_id: r.text for r in site_templates.main_texts(pages).collect()}
    counted = [r for r in named if sizes[r.host] >= site_templates.MIN_PAGES]
    assert len(counted) > 100
    assert all(got[r.page_id] != site_templates.main_text(r.html or "", site_templates.Template(sizes[r.host], set())) for r in counted)


def test_op2_counts_equal_brute_force(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.example/", site(k % 5)) for k in range(20)], "page_id long, url string, html string")
    want = {}
    for r in pages.collect():
        for d, kind, _ in site_templates.page_digests(r.html):
            want[r.url[7:17], d, kind] = want.get((r.url[7:17], d, kind), 0) + 1
    got = {(r.host, r.digest, r.kind): r.n for r in site_templates.subtree_counts(pages).collect() if r.digest is not None}
    assert got == {k: n for k, n in want.items() if n >= 2}


def test_op2_odd_markup():
    none = site_templates.Template(1, set())
    assert site_templates.main_text("a < b <!-- x > y --> c <b title='>'>d</b> <p>e<script>if (a < b) '</p>'</script>f", none) == "a < b c d\ne f".replace("e f", "ef")
    assert site_templates.main_text("<p>one<li>two<li>three<td>four", none) == "one\ntwo\nthree\nfour"
    for junk in ("<a " * 300_000, "<div>" * 30_000, "<p><div>" * 10_000 + "<p></b>" * 10_000, '<a "' * 100_000, "<!--" * 100_000, "<script>" * 50_000, "<li>" * 30_000):
        site_templates.main_text(junk, none)  # linear: the whole list takes seconds
        site_templates.main_text(junk, site_templates.Template(9, set()))


def test_op1_risk_equals_brute_force():
    """The risk by its definition, text by text, and its gradient by finite differences."""
    draw = np.random.default_rng(5)
    k, prior = 6, 0.3

    def texts(n):
        sets = [draw.choice(k, draw.integers(0, k), replace=False) for _ in range(n)]
        return sets, (np.concatenate(sets).astype(int), np.repeat(np.arange(n), [len(x) for x in sets]), n)

    (p_sets, p), (u_sets, u) = texts(7), texts(11)
    w = draw.standard_normal(k + 1)
    z = lambda sets: np.array([w[s].sum() + w[k] for s in sets])
    loss = lambda z: np.log1p(np.exp(-z)).mean()
    negative, positive, g_positive, g_negative = toxicity.risk(w, p, u, prior)
    assert np.isclose(positive, prior * loss(z(p_sets))) and np.isclose(negative, loss(-z(u_sets)) - prior * loss(-z(p_sets)))
    for j in range(k + 1):
        step = np.zeros(k + 1)
        step[j] = 1e-6
        up, down = (toxicity.risk(w + s, p, u, prior) for s in (step, -step))
        assert np.isclose((up[1] - down[1]) / 2e-6, g_positive[j], atol=1e-6) and np.isclose((up[0] - down[0]) / 2e-6, g_negative[j], atol=1e-6)


def test_op6_broken_tables_and_deep_boxes():
    data = bytearray(iso_media.write_raw_video(bytes(192 * 60)))
    at = bytes(data).index(b"stsc") + 12
    data[at : at + 4] = (2).to_bytes(4, "big")  # the first run doesn't begin at the first chunk
    with pytest.raises(iso_media.MediaError):
        iso_media.probe(bytes(data))
    runs = iso_media.full_box(b"stsc", (3).to_bytes(4, "big"), *(b"".join(x.to_bytes(4, "big") for x in r) for r in ((1, 1, 1), (5, 1, 1), (2, 1, 1))))
    whole = iso_media.write_raw_video(bytes(192 * 60))
    old = whole.index(b"stsc") - 4
    size = int.from_bytes(whole[old : old + 4], "big")
    boxes = {kind: (a, b) for kind, a, b in iso_media.walk(whole, 0, len(whole))}
    mended = whole[:old] + runs + whole[old + size :]
    table = {k: (a + (len(runs) - size if a > old + 8 else 0), b + (len(runs) - size if b > old else 0)) for k, (a, b) in boxes.items()}
    with pytest.raises(iso_media.MediaError):
        iso_media._track(mended, table)
    deep = b""
    for _ in range(3_000):
        deep = iso_media.box(b"moov", deep)
    assert iso_media.probe(deep) == [] and sum(1 for _ in iso_media.walk(deep, 0, len(deep))) == 3_000


def test_op3_null_ids(spark):
    rows = [(None, "a b"), (3, None), (1, "c"), (None, "a b")]
    out = token_files.token_file_digests(spark.createDataFrame(rows, "doc_id long, text string"), queries.public_path(queries.WORD_BPE)).collect()
    by_start = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None, None, 1, 3] and [r.start for r in by_start] == [0, 3, 6, 8] and [r.n_tokens for r in by_start] == [3, 3, 2, 1]


def test_op7_rejects_what_no_language_leads():
    """Long texts of no known language are rejected however many bytes one happens to lead by; single words are kept."""
    draw = random.Random(3)
    words = {lang: ["".join(draw.choice(letters) for _ in range(draw.randint(2, 9))) for _ in range(900)] for lang, letters in (("x", "abcdefgh"), ("y", "ijklmnop"))}
    model = language.CompressionClassifier({k: [" ".join(draw.sample(v, 700)).encode() for _ in range(3)] for k, v in words.items()})
    junk = " ".join("".join(draw.choice("qrstuvwz") for _ in range(7)) for _ in range(3_000))
    assert model.predict(junk)[2]
    for lang, own in words.items():
        for n in (1, 5, 400):
            text = " ".join(draw.sample(own, n))
            assert model.predict(text)[0] == lang and not model.predict(text)[2]
    sizes = {lang: sum(len(c.compress(anchor + language.distinct_words(own[0]))) - base for c, anchor, base in cs) / len(cs) for (lang, cs), own in zip(zip(model.dictionaries, model._prepare(), strict=True), [words["x"]] * 2, strict=True)}
    assert np.allclose(list(sizes.values()), model.sizes(words["x"][0]))  # brute force: every dictionary encodes the text
