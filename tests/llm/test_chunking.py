import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parleyworks.llm.chunking import pieces, split_texts


def holds(text, limit, overlap):
    p = pieces(text, limit, overlap)
    if not text:
        assert p == []
        return p
    assert p[0][0] == 0 and p[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in p)
    for (a, b), (c, d) in zip(p, p[1:]):
        assert c == max(0, b - overlap) and d > b
    return p


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#-1)`。", max_size=700), st.integers(20, 120), st.integers(0, 19))
def test_cover_limit_and_overlap(text, limit, overlap):
    p = holds(text, limit, overlap)
    # nothing is lost or changed: own parts put together give the text
    at, parts = 0, []
    for _, b in p:
        parts.append(text[at:b])
        at = b
    assert "".join(parts) == text


def test_natural_boundaries():
    para = ("A sentence of some words here. " * 12).strip()
    text = "\n\n".join(f"# Head {k}\n\n{para}" for k in range(6))
    p = holds(text, 900, 100)
    assert all(text[b:].startswith("# Head") or text[:b].endswith(("\n\n", ". ")) for _, b in p[:-1])
    code = "```\n" + "x = 1\n" * 50 + "```"
    text = para + "\n\n" + code + "\n\n" + para
    p = holds(text, 600, 50)
    assert any(text[a + 50 if a else 0 : b].strip().startswith("```") or code in text[a:b] for a, b in p)


def test_very_long_and_bad_parameters():
    holds("x" * 200_000, 2000, 200)
    holds("word " * 50_000, 2000, 200)
    with pytest.raises(ValueError):
        pieces("abc", 10, 10)


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, "short", "p"), (4, "w " * 3000, "p"), (4, "w " * 3000, "p")], "id int, text string, piece_ string")
    got = split_texts(df)
    assert got.select("id").distinct().collect()[0][0] == 4
    assert got.where("length(piece) > 2000").count() == 0
    assert split_texts(df, only_long=False).where("id = 3").count() == 1
    assert split_texts(df.limit(0)).count() == 0


def test_nested_items_stay_with_their_item():
    inner = "".join(f"  - inner {k} " + "word " * 8 + "\n" for k in range(3))
    text = "".join(f"- outer {k} " + "word " * 8 + "\n" + inner for k in range(8))
    p = holds(text, 420, 20)
    assert all(text[b:].startswith("- outer") for _, b in p[:-1])
    # an item that is too large itself is cut between the items below it
    p = holds("- outer " + "word " * 8 + "\n" + inner * 6, 420, 20)
    assert len(p) > 1 and all(("- outer " + "word " * 8 + "\n" + inner * 6)[b:].startswith("  - inner") for _, b in p[:-1])


def test_items_and_sentences_inside_code_are_none():
    code = "```\n" + "".join(f"- x{k}. Y = {k}\n" for k in range(40)) + "```\n"
    p = holds("before\n\n" + code + "\nafter", 200, 0)
    assert all(("before\n\n" + code + "\nafter")[b - 1] == "\n" for _, b in p[:-1])
