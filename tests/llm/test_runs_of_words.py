import random

import numpy as np

from tidelog.llm import compact_windows
from tidelog.llm.set_join import ngrams_of


def junk_windows(draw, n, longest):
    """Windows of one bucket, of texts that repeat one word after another; all have a run of the first word somewhere."""
    rows = []
    for doc in range(n):
        size, runs = draw.randint(15, longest), [f"w{draw.randint(0, 12)}" for _ in range(draw.randint(2, 9))]
        at = draw.randrange(len(runs))
        runs[at] = "w0"
        tokens = ngrams_of([" ".join(w for w in runs for _ in range(size))], 5)[0]
        rows.append((doc, -doc, at * size, 0, len(tokens) - 1, False, False, (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()))
    return rows


def test_only_pairs_with_a_passage_are_handed_on(monkeypatch):
    """Runs of a word make stretches of near tokens in very many pairs; only those that make a passage of the windows leave the cell."""
    draw = random.Random(31)
    for longest in (70, 40):
        rows = junk_windows(draw, 150, longest)
        tokens = [np.frombuffer(r[7], np.uint32) for r in rows]

        def seeds():
            return {x[:10:2] for x in compact_windows.Cell(rows, 46, 80, 5).seeds()}

        found = seeds()
        for a, b, ca, _, _ in [(x[0], x[1], *x[2:]) for x in found]:
            seed = (rows[a][2], 0, len(tokens[a]) - 1, rows[b][2], 0, len(tokens[b]) - 1)
            assert compact_windows.passage_around(tokens[a], tokens[b], seed, 46, 80, 5), (a, b, ca)
        monkeypatch.setattr(compact_windows, "PAYS", 1 << 30)
        assert found and seeds() <= found
        monkeypatch.undo()


def test_what_is_turned_away_at_once_has_no_passage():
    draw = random.Random(32)
    rows = junk_windows(draw, 120, 60)
    cell = compact_windows.Cell(rows, 46, 80, 5)
    turned, kept = 0, 0
    for b in range(40, 120):
        others = np.arange(b)
        may = cell._similar(b, others)
        for a in others.tolist():
            seed = (rows[a][2], 0, len(cell.held[a]) - 1, rows[b][2], 0, len(cell.held[b]) - 1)
            p = compact_windows.passage_around(cell.held[a], cell.held[b], seed, 46, 80, 5)
            assert may[a] or p is None, (a, b)
            turned, kept = turned + (not may[a]), kept + (p is not None)
    assert turned > 4_000 and kept > 10


def test_windows_beyond_what_is_held_go_on_to_be_followed():
    """Edited so that no passage lies near the shared token, and longer than is held: the texts have to be looked at."""
    draw = random.Random(33)
    rows = junk_windows(draw, 2, 60)
    long = [(*r[:3], 0, 5_000, *r[5:]) for r in rows]
    cell = compact_windows.Cell(long, 46, 80, 5)
    assert not cell.full.any() and cell._similar(1, np.arange(1)).all() and cell._may(0, 1, (1, 1))
