import numpy as np

from tidelog.llm import set_join


def draws(draw, n):
    return np.unique(draw.integers(0, 1 << 62, n)).astype(np.uint64)


def test_unrelated_sets_share_no_signature():
    """Empty subsets, which are alike in unrelated sets, are no signatures."""
    draw = np.random.default_rng(3)
    for percent in (80, 90):
        bands = set_join.Bands(percent, 230_000)
        every = np.concatenate([bands.signatures(draws(draw, n)) for n in range(40, 1_000, 3)])
        assert len(np.unique(every)) == len(every)


def test_similar_sets_share_a_signature():
    """All sizes, differences up to the bound, on few segments of each band, so that many of them are empty or lose nothing."""
    draw = np.random.default_rng(4)
    met = 0
    for percent in (50, 80, 90):
        for documents in (2, 10**6, 10**12):
            bands = set_join.Bands(percent, documents)
            for n in [*range(1, 60), *range(60, 500, 23)]:
                for _ in range(6):
                    a = draws(draw, n)
                    lost, won = draw.integers(0, n * (100 - percent) // 100 + 1, 2)
                    b = np.unique(np.concatenate([draw.permutation(a)[lost:], draws(draw, won)]))
                    if set_join.similar(a, b, percent):
                        met += 1
                        assert np.intersect1d(bands.signatures(a), bands.signatures(b)).size, (percent, documents, n, lost, won)
    assert met > 1_000
