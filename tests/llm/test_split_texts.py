import numpy as np

from tidelog.llm import tokens

TEXTS = ["Don't stop, WE'RE here's 'twas (so)", "a\x1cb\x1dc \x1e\x1f d", "x\x85y\xa0z\x0bw", "naïve Émile œuvre ÿ's", "word,word. " * 3, "q" * 100 + " " + "r." * 60, "12 345 a1b2", "", " \n ", "<|endoftext|> é"]


def test_texts_split_at_white_space_give_the_librarys_ids():
    t = tokens.PieceTokenizer(tokens.public_path("word_bpe_49k.json"))
    for _ in range(2):
        for text, ids in zip(TEXTS, t.encode(TEXTS), strict=True):
            assert np.array_equal(ids, t.ids(text)), text
    assert "(so)" in t.known and "word,word." in t.known
    assert max(map(len, t.known)) <= tokens.LONGEST


def test_what_comes_late_is_forgotten():
    t = tokens.PieceTokenizer(tokens.public_path("word_bpe_49k.json"), max_remembered=4)
    list(t.encode(["one two three"]))
    for text in ("four, five", "six seven, one"):
        assert np.array_equal(list(t.encode([text]))[0], t.ids(text))
    assert set(t.known) == {"one", "two", "three"}
