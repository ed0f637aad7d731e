import unicodedata

import numpy as np
import pytest

from parleyworks.llm.language import Model, label_code, label_texts, segments, train

TEXTS = {
    "en": "The old lock keeps the archive open before the lease expires. The parser returns an empty list when the queue is full and nobody reads the file.",
    "de": "Die alte Sperre hält das Archiv offen vor dem Ablauf der Frist. Der Parser liefert eine leere Liste und niemand liest die Datei, weil die Schlange voll ist.",
    "fr": "Un ancien verrou garde le fichier ouvert avant la fin du délai. Le lecteur renvoie une liste vide et la file est pleine depuis mardi dernier.",
    "ru": "Старый замок держит архив открытым до истечения срока. Разборщик возвращает пустой список и никто не читает файл.",
    "ja": "古いロックは期限が切れる前に書庫を開いたままにする。新しい解析器は空の一覧を返す。",
    "zh": "旧的锁在期限到来之前一直占着连接。新的解析器返回空列表。",
    "ko": "오래된 잠금이 기한이 지나기 전에 보관 파일을 연다. 새 파서가 빈 목록을 돌려줍니다.",
}


@pytest.fixture(scope="module")
def model():
    return Model([(lang, t) for lang, t in TEXTS.items() for _ in range(3)])


def langs(model, text):
    return [s[0] for s in label_texts(model, [text])[0][0]]


def test_single_and_mixed(model):
    for lang, t in TEXTS.items():
        assert set(langs(model, t)) == {lang}
    assert langs(model, "The parser returns an empty list.\nDie alte Sperre hält das Archiv offen. 旧的锁返回空列表。") == ["en", "de", "zh"]
    # a foreign word or two inside a sentence don't make it another language's
    assert set(langs(model, "The parser keeps die Sperre open when the queue is full.")) == {"en"}


def test_variants(model):
    assert set(langs(model, TEXTS["de"].upper())) == {"de"}
    assert set(langs(model, TEXTS["de"].replace("ä", "a"))) == {"de"}


def test_code_has_no_language(model):
    for t in ("`read_queue(30)`", "```\nx = open_file[3]\n```", "/work/src/open_file.ts:32", "", None, "1234 !!", "setItem(42)"):
        assert label_texts(model, [t]) == ([[]], [[]])


def test_positions_and_confidence(model):
    t = "The parser returns an empty list. Die alte Sperre hält das Archiv offen."
    found, runs = label_texts(model, [t, t])
    assert found[0] == found[1]
    (a, ca, s1, e1), (b, cb, s2, e2) = found[0]
    assert (t[s1:e1], t[s2:e2]) == ("The parser returns an empty list", "Die alte Sperre hält das Archiv offen")
    assert 0.5 < ca <= 1 and 0.5 < cb <= 1
    assert [r[0] for r in runs[0]] == ["en", "de"] and [r[2:] for r in runs[0]] == [(s1, e1), (s2, e2)]


def test_labels():
    assert [label_code(x) for x in ("EN", "en-US", "English", "eng", " de_DE ", "und", "", None, "?", "zh-CN", "Korean", "klingon")] == ["en", "en", "en", "en", "de", None, None, None, None, "zh", "ko", None]


def test_frames(spark, model):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, TEXTS["fr"], "x"), (4, TEXTS["en"] * 300, "y")], "id int, text string, lang_ string")
    got = segments(df, model)
    assert {r["id"]: r["lang"] for r in got.collect()} == {3: "fr", 4: "en"}
    assert segments(df.limit(0), model).count() == 0


def test_held_out_accuracy(spark, data):
    """Documents that the model wasn't trained on, by their labels."""
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = train(docs.where("doc_id % 2 = 0"), id_col="doc_id")
    rows = docs.where("doc_id % 2 = 1 and lang is not null and length(text) > 0").select("lang", "text").collect()
    found = label_texts(model, [r["text"] for r in rows])[0]
    right = [max(set(x := [s[0] for s in f]), key=x.count) == r["lang"].lower() for r, f in zip(rows, found) if f]
    assert np.mean(right) > 0.97


def test_a_short_sentence_that_is_clear_counts():
    """One or two words are a sentence of their own language if they leave no doubt; unknown ones say nothing."""
    model = Model([(lang, t) for lang, t in (TEXTS | {"de": TEXTS["de"] + " Vielen Dank. Wir sagen vielen Dank."}).items() for _ in range(3)])
    assert langs(model, "The parser returns an empty list. Vielen Dank. Nobody reads the file.") == ["en", "de", "en"]
    assert langs(model, "The parser returns an empty list. Спасибо. Nobody reads the file.") == ["en", "ru", "en"]
    assert langs(model, "The parser returns an empty list. Oskel. Nobody reads the file.") == ["en", "en"]


@pytest.fixture(scope="module")
def trained(spark, data):
    return train(spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet"), id_col="doc_id")


def spans(model, text):
    return [(lang, text[a:b]) for lang, _, a, b in label_texts(model, [text])[1][0]]


def test_a_stretch_inside_a_sentence_is_a_segment(trained):
    text = "The parser logs a warning and el trabajo nocturno devuelve una lista vacía desde el martes pasado before the lease expires and the archive is full."
    assert [lang for lang, _ in spans(trained, text)] == ["en", "es", "en"]
    assert spans(trained, text)[1][1].startswith("el trabajo") and spans(trained, text)[1][1].endswith("martes pasado")


@pytest.mark.parametrize(
    "text",
    [
        "Det gamla låset håller arkivet öppet innan tiden går ut och ingen läser filen längre.", "Vanha lukko pitää arkiston avoinna ennen kuin määräaika umpeutuu eikä kukaan lue tiedostoa.",
        "Stary zamek trzyma otwarte archiwum przed upływem terminu i nikt nie czyta pliku.", "Αυτό το αρχείο μένει ανοιχτό μέχρι τη λήξη της προθεσμίας.",
    ],
)
def test_languages_that_the_model_does_not_know(trained, text):
    whole, runs = label_texts(trained, [text])
    assert whole[0] == [] and {r[0] for r in runs[0]} <= {"und"}


def test_places_are_those_of_the_text_as_given(trained):
    text = unicodedata.normalize("NFD", "Die alte Sperre hält das Archiv offen, weil die Schlange über Nacht voll läuft.")
    assert spans(trained, text) == [("de", text[:-1])]


def test_prose_that_ends_like_code_is_prose(trained):
    for t in ("Wir haben das gestern so besprochen;", "For the record, the archive is full (as before).", "If the build fails, nobody reads the log; the parser keeps it.", "Zur Erinnerung: das Archiv ist voll."):
        assert label_texts(trained, [t])[0][0], t
    for t in ("return x;", "const a = f(1);", "  replicas: 3\n  image: repo/app:1.2\n  kind: Deployment", "for i in range(10):", "if (x == 1) {", "etag: ab12", "break;"):
        assert label_texts(trained, [t])[0][0] == [], t
