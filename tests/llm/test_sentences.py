from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parleyworks.llm.sentences import _FIRST, _cased, _first_word, blocks, sentence_units, train, units


@pytest.fixture(scope="module")
def model(spark, data):
    return train(spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet"))


CASES = {
    "Mr. J. K. Oskel owns that module, cf. the notes of Jan. 2. The parser logs a warning.": ["Mr. J. K. Oskel owns that module, cf. the notes of Jan. 2.", "The parser logs a warning."],
    "The rate rose from 9.25 to 14.7 percent. It fell again!": ["The rate rose from 9.25 to 14.7 percent.", "It fell again!"],
    'The reviewer said: "Retry it. Then check the log." The parser logs a warning.': ['The reviewer said: "Retry it. Then check the log."', "The parser logs a warning."],
    '"Does it still fail?" asked the reviewer, and nobody answered. The parser logs a warning.': ['"Does it still fail?" asked the reviewer, and nobody answered.', "The parser logs a warning."],
    "# Head\n\nOne line\nbroken here. The second\none.": ["# Head", "One line\nbroken here.", "The second\none."],
    "- one item. The parser logs a warning.\n- two": ["- one item.", "The parser logs a warning.", "- two"],
    "1. The parser\n2. The archive": ["1. The parser", "2. The archive"],
    "User: The parser logs a warning. The archive is full.\nAssistant: The archive is full.": ["User: The parser logs a warning.", "The archive is full.", "Assistant: The archive is full."],
    "> The archive is full. The parser logs a warning.": ["> The archive is full.", "The parser logs a warning."],
    "Before.\n\n```py\nx = 1.\n\ny = 2. Z\n```\n\nAfter.": ["Before.", "```py\nx = 1.\n\ny = 2. Z\n```", "After."],
    "夜间任务忽略了项目范围。比例从5.11%升到15.4%！日志里写着：“再试一次。然后检查。”旧的锁改了列名。": ["夜间任务忽略了项目范围。", "比例从5.11%升到15.4%！", "日志里写着：“再试一次。然后检查。”", "旧的锁改了列名。"],
    "「まだ失敗しますか？」と査読者が聞いた。索引は書庫全体を読み込みます。": ["「まだ失敗しますか？」と査読者が聞いた。", "索引は書庫全体を読み込みます。"],
    "ล็อกเก่าเปลี่ยนชื่อคอลัมน์ เซสชันนี้ถือการเชื่อมต่อค้างไว้": ["ล็อกเก่าเปลี่ยนชื่อคอลัมน์", "เซสชันนี้ถือการเชื่อมต่อค้างไว้"],
    "क्या काम पूरा हुआ? डॉ. ओस्केल ने दर बताई। काम हुआ।": ["क्या काम पूरा हुआ?", "डॉ. ओस्केल ने दर बताई।", "काम हुआ।"],
    "待って……これは変だ。索引は書庫全体を読み込みます。": ["待って……これは変だ。", "索引は書庫全体を読み込みます。"],
    "Wait... the cursor moved by itself?! iOS clients see the old row first.": ["Wait... the cursor moved by itself?!", "iOS clients see the old row first."],
    "새 파서가 빈 목록을 돌려줍니다. scan_fact.py 수정이 오류를 알린다.": ["새 파서가 빈 목록을 돌려줍니다.", "scan_fact.py 수정이 오류를 알린다."],
    "The parser logs a warning.\r\n\r\nThe archive is full.": ["The parser logs a warning.", "The archive is full."],
    "Siehe Abs. 3 bzw. Nr. 5 der Notiz. Die Umstellung meldet einen Fehler.": ["Siehe Abs. 3 bzw. Nr. 5 der Notiz.", "Die Umstellung meldet einen Fehler."],
}


@pytest.mark.parametrize("text", list(CASES))
def test_cases(model, text):
    assert [text[a:b] for a, b in units(text, model)] == CASES[text]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='aB1 .!?\n\n"()“”。`#->:\t', max_size=300))
def test_units_cover_the_text(model, text):
    u = units(text, model)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in u)
    assert all(x[1] <= y[0] for x, y in zip(u, u[1:]))
    assert "".join("".join(text[a:b] for a, b in u).split()) == "".join(text.split())


def test_null_empty_and_long(model, spark):
    assert units(None, model) == units("", model) == units(" \n ", model) == []
    assert len(units("The archive is full. " * 5_000, model)) == 5_000
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "The archive is full. The parser logs a warning.", 7), (3, "The archive is full. The parser logs a warning.", 7)], "doc_id bigint, text string, end_pos_ int")
    assert sorted(tuple(r) for r in sentence_units(df, model).select("doc_id", "start_pos").collect()) == [(3, 1), (3, 1), (3, 22), (3, 22)]
    assert sentence_units(df.limit(0), model).count() == 0
    assert train(spark.createDataFrame([], "doc_id bigint, text string")) is not None


def test_words_are_counted_over_all_documents(spark, data):
    """However few texts the weights are fitted on, the counts are those of the whole table, by another count of single texts."""
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    texts = [r["text"] for r in docs.collect() if r["text"]]
    heads, words = Counter(), Counter()
    for text in texts:
        for _, b, e, whole in blocks(text):
            if not whole and _cased(text):
                heads[_first_word(text, b, e)] += 1
                words.update(m.group() for m in _FIRST.finditer(text, b, e))
    few = train(docs, sample=40)
    frequent = [w for w, n in words.items() if n >= 5 and w in few.any and not w.startswith("~")]
    assert len(frequent) > 100 and all((few.opening[w], few.any[w]) == (heads[w], words[w]) for w in frequent)
    assert {w for w in heads if words[w] >= 5} <= set(few.any)
    every = train(docs)
    same = [w for w in every.seen if every.seen[w] >= 5]
    assert same and all((few.final[w], few.seen[w]) == (every.final[w], every.seen[w]) for w in same)


def test_a_rare_word_outside_the_sample_divides(spark):
    """A terminator without a blank is decided by counts alone, those of words seen once too."""
    plain = [(k, "The parser logs a warning. The archive is full.\n\nNothing else was said, cf. the notes.") for k in range(400)]
    rare = [(k, f"We saw the zephyr.\n\nQuorum was reached.\n\nWe saw the zephyr.Quorum was reached. {k}") for k in range(400, 402)]
    model = train(spark.createDataFrame(plain + rare, "doc_id bigint, text string"), sample=4)
    text = "We saw the zephyr.Quorum was reached."
    assert [text[a:b] for a, b in units(text, model)] == ["We saw the zephyr.", "Quorum was reached."]
