import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parleyworks.llm.leakage import Pieces, leaked, myers, piece_length, plain_words

ITEM = "In the town of Sedgemere the miller stores 718 copper kettles and sells 701 of them to a travelling weaver before the autumn fair begins"


def distance(p, t):
    row = list(range(len(p) + 1))
    out = []
    for c in t:
        new = [0]
        for k, x in enumerate(p):
            new.append(min(row[k] + (x != c), row[k + 1] + 1, new[k] + 1))
        row = new
        out.append(row[-1])
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), max_size=25))
def test_myers(p, t):
    assert myers(p, t) == distance(p, t)


@pytest.mark.parametrize("run,budget", [(12, 0), (12, 1), (12, 2), (5, 0)])
def test_pigeonhole(run, budget):
    p = piece_length(run, budget)
    for start in range(40):
        assert sum(1 for a in range(0, 80, p) if start <= a and a + p <= start + run) >= budget + 1


def test_forms():
    words = ITEM.split()
    pieces = Pieces([(1, ITEM), (2, "too short to leak"), (3, "")])
    yes = [
        " ".join(words[5:17]), ITEM.upper(), "x " + ITEM.replace(" ", "\n") + " y", ", ".join(words), ITEM.replace("miller", "mil­ler").replace("t", "t​"), ITEM.replace("S", "Ｓ").replace("7", "７"), " **".join(words[:13]),
    ]
    no = [" ".join(words[5:16]), " ".join(w if k % 6 else "odd" for k, w in enumerate(words)), " ".join(random.Random(1).sample(words, len(words))), "", None, "z" * 100_000]
    assert all(pieces.leaks(t) == [(1, 0)] for t in yes)
    assert not any(e == 0 for t in no for _, e in pieces.leaks(t))
    assert plain_words("café CAFÉ ﬁ") == ["café", "café", "fi"]


def test_budget():
    words = ITEM.split()
    changed = words[:6] + ["other"] + words[7:14]
    assert Pieces([(1, ITEM)], budget=0).leaks(" ".join(changed)) == []
    assert Pieces([(1, ITEM)], budget=1).leaks(" ".join(changed)) == [(1, 1)]
    assert Pieces([(1, ITEM)]).leaks("so " + " ".join(words[:4] + ["very"] + words[4:8] + words[9:14]) + " it is") == [(1, 2)]


@pytest.mark.parametrize("budget", [0, 1, 2])
def test_edits_against_brute_force(budget):
    """Planted passages with random edits: the errors are the least distance of any run of the item to any stretch of the text."""
    r = random.Random(budget)
    items = [(k, " ".join(f"w{r.randrange(40)}" for _ in range(18))) for k in range(6)]
    pieces = Pieces(items, run=8, budget=budget)
    for _ in range(80):
        words = [f"w{r.randrange(40)}" for _ in range(10)]
        part = r.choice(items)[1].split()[3:14]
        for _ in range(r.randrange(4)):
            k = r.randrange(len(part))
            part[k : k + 1] = r.choice([[], ["odd"], [part[k], "odd"]])
        text = words[:5] + part + words[5:]
        want = {}
        for i, t in items:
            t = t.split()
            least = min(min(distance(t[k : k + 8], text)) for k in range(len(t) - 7))
            if least <= budget:
                want[i] = least
        assert dict(pieces.leaks(" ".join(text))) == want


def test_brute_force():
    r = random.Random(7)
    vocab = [f"w{k}" for k in range(8)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(20))) for k in range(15)]
    pieces = Pieces(items, run=5, budget=0)
    for _ in range(60):
        text = " ".join(r.choice(vocab) for _ in range(40))
        runs = {tuple(text.split()[k : k + 5]) for k in range(36)}
        want = [i for i, t in items if any(tuple(t.split()[k : k + 5]) in runs for k in range(16))]
        assert sorted(i for i, _ in pieces.leaks(text)) == want


def test_frames(spark, ws):
    docs = spark.createDataFrame([(1, "before " + ITEM, "t"), (1, "before " + ITEM, "t"), (2, None, "t"), (3, "", "t"), (4, "nothing", "t")], "doc_id bigint, text string, item_id_ string")
    items = spark.createDataFrame([(9, ITEM), (8, None)], "item_id bigint, text string")
    assert [tuple(r) for r in leaked(docs, items, ws).collect()] == [(1, 9, 0)]
    assert [tuple(r) for r in leaked(docs, items, ws, per_block=1).collect()] == [(1, 9, 0)]
    assert leaked(docs.limit(0), items, ws).count() == 0 and leaked(docs, items.limit(0), ws).count() == 0
