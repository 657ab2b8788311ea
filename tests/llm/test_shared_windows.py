from collections import defaultdict

import numpy as np

from tidelog.llm import common, compact_windows


def cell(draw, kind):
    """Windows of a bucket: strangers that share the seed, a line of 20 tokens, or a passage of 60 with one token changed; texts of some 120 tokens."""
    seed, line, passage = draw.integers(0, 1 << 32, 1), draw.integers(0, 1 << 32, 20), draw.integers(0, 1 << 32, 60)
    rows = []
    for doc in range(int(draw.integers(2, 9))):
        x = passage.copy()
        x[int(draw.integers(5, 20))] += doc
        middle = {"seed": seed, "line": line, "passage": x}[kind]
        tokens = np.concatenate([draw.integers(0, 1 << 32, 50), middle, draw.integers(0, 1 << 32, 30)])
        c = 50 + {"seed": 0, "line": 7, "passage": 30}[kind]
        rows.append((doc, -doc, c, 0, len(tokens) - 1, False, False, tokens.astype(np.uint32).tobytes()))
    return rows


def test_no_cell_with_a_pair_is_turned_away():
    draw = np.random.default_rng(7)
    kinds = [str(draw.choice(["seed", "line", "passage"])) for _ in range(300)]
    cells = [cell(draw, k) for k in kinds]
    may = compact_windows.promising(cells, 46, 80)
    assert may == [k == "passage" for k in kinds]
    for rows, found in zip(cells, may, strict=True):
        assert found == any(True for _ in compact_windows.Cell(rows, 46, 80, 5).seeds())
    # windows that the centre links need no look at each other
    linked = [[(*r[:5], True, *r[6:]) for r in rows[:-1]] + [rows[-1]] for rows in cells]
    assert compact_windows.promising(linked, 46, 80) == may
    assert compact_windows.promising(cells, 90, 80) == [True] * 300  # too wide for it


def test_shared_windows_equal_brute_force(spark):
    """Equal texts in other rows don't make a key shared; a key that very many texts have stays whole."""
    draw = np.random.default_rng(8)
    common_part = " ".join(f"same{k}" for k in range(60))
    texts = [" ".join(f"w{n}" for n in draw.integers(0, 10**6, 150)) + (" " + common_part if k % 3 else "") for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts[:7])], "doc_id long, text string").repartition(5)
    rows = common.staged(compact_windows.all_windows(docs, 5, 46, 4), "test")
    every = set()
    for x in rows.where("part is not null").collect():
        every |= set(zip(*(c.tolist() for c in compact_windows.unpacked([x.data], ("i8", "i8", "i4", "i4", "i4"))), strict=True))
    having = defaultdict(set)
    for key, txt, *_ in every:
        having[key].add(txt)
    wanted = {w for w in every if len(having[w[0]]) > 1}
    assert wanted and wanted != every
    assert {tuple(x) for x in compact_windows.shared_windows(rows).collect()} == wanted
