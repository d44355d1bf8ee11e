from __future__ import annotations

import time

import pytest

from rollcall.llm.sentences import sentence_spans, split_sentences, wrap_width


def units(text, **k):
    return [text[a:b] for a, b in sentence_spans(text, **k)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. A. Marlo met Prof. Dr. B. Tenno at 9.30 a.m. on Jan. 3, 2020.", "It cost 4.50 per unit."],
        ["See Fig. 8.3 and no. 25.", "No. 10 repeats no. 12.", "Who asked?", "Nobody!"],
        ["“It is ours. We pay,” Ada Quill told the panel.", "“Who asked?” wrote Bo Lind, “and why now?”", "Then it ended."],
        ["Das gilt z. B. für Nr. 33 am 31. Dezember.", "Im 3. Stock sitzen 28.", "Ob das stimmt, ist offen ...", "„Wer unterschreibt?“", "Alle gehen."],
        ["« Qui signe ? »", "Le Pr M. Alba vient, cf. art. 33.", "M. T. Storo a quitté Paris."],
        ["La dott.ssa V. K. Rana compare, cfr. p. 76.", "Ecco!"],
        ["Los EE. UU. quedan fuera.", "¿Por qué sigue?", "¡Ya no existe!"],
        ["В 2011 г. группа переехала в г. Ольшанка.", "Это т. е. всё.", "«Она независима. Бюджет свой», — сказал А. Б. Кулин."],
        ["Ποιος υπογράφει για την ομάδα;", "Βλ. σελ. 26 του πρακτικού."],
        ["प्रो. श्रीगोपन वर्ष 2015 से यहाँ हैं।", "“समूह स्वतंत्र है। उसका बजट है,” डॉ. चंद्र ने कहा।"],
        ["من يوقع؟", "قال د. كرم البحيري ذلك.", "انتهى."],
        ["The post went to A; the other to B: both stay.", "Nobody replied ... and the case stayed open."],
    ],
)
def test_running_text(parts):
    assert units(" ".join(parts)) == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["「研究室は独立している。予算も別だ。」と星ヶ浦氏は述べた。", "誰が担当なのか？", "版は v. 2.5 のままである。"],
        ["“课题组是独立的。我们有自己的经费。”上官琳珂在会上说。", "“谁来签字？”", "密度从5.7上升到9.2。", "真的吗？！"],
    ],
)
def test_scripts_without_blanks(parts):
    assert units("".join(parts)) == parts


def test_thai_blanks():
    parts = ["รัศมี 45.6 กม. รวมเมืองอื่นเข้าไปด้วย", "ใครเป็นผู้ลงนามแทนกลุ่ม", "ดร. สุรเชษฐ์ ย้ายไปสถาบันอื่นเมื่อปีที่แล้ว", "หมายเลข 15 ซ้ำกับหมายเลข 42"]
    assert units(" ".join(parts)) == parts


def test_layouts():
    assert units("8. Open cases\n\nThe map is old.\n- Ada Quill: include\n- Bo Lind: exclude\n| a | 3 | x |\nTable 2.1 Recall") == ["8. Open cases", "The map is old.", "- Ada Quill: include", "- Bo Lind: exclude", "| a | 3 | x |", "Table 2.1 Recall"]
    assert units("Prof. Aru moved from the southern campus of Namgel to the\nnorthern one in Sept. 2025, as the page says. It is far.") == ["Prof. Aru moved from the southern campus of Namgel to the\nnorthern one in Sept. 2025, as the page says.", "It is far."]
    assert units("the final mark is lost here\nThe next line begins anew.") == ["the final mark is lost here", "The next line begins anew."]
    assert units("a blank is lost here.The next begins. See www.x.example/a.B?c=1 for more.") == ["a blank is lost here.", "The next begins.", "See www.x.example/a.B?c=1 for more."]


def test_nothing_lost_and_empty_texts():
    for t in (None, "", " \n\t ", " "):
        assert sentence_spans(t) == []
    for t in ("?", "...", "a", "“", "(", "\n\nx\n\n", "a.\r\nB", "“unclosed. Quote here.\n\nNew one.", "¿?¡!", "1. 2. 3.", "A. B. C."):
        got = units(t)
        assert "".join("".join(got).split()) == "".join(t.split())


def test_long_texts_stay_linear():
    t = "The ledger keeps 17 decisions; none was overwritten. " * 20_000
    assert len(sentence_spans(t)) == 20_000
    assert len(sentence_spans("x" * 300_000)) == 1


def test_on_tables(spark, rows):
    df = spark.createDataFrame([(1, "Ab. Cd.", "en", "x"), (2, None, "en", "x"), (3, "", None, "x"), (1, "E.", "en", "y")], "doc_id long, text string, lang string, start_char string")
    assert rows(split_sentences(df)) == [(1, 0, 2), (1, 0, 3), (1, 4, 7)]
    assert rows(split_sentences(df.filter("false"))) == []


@pytest.mark.parametrize("lang", ["en", "und", None, "en-GB"])
def test_words_that_other_languages_shorten_end_english_sentences(lang):
    for parts in (["He told me.", "Then he left."], ["The light was on.", "She slept well."], ["They built an arch.", "It fell down."], ["She used a rag.", "It was wet."], ["He went to bed.", "25 people came."], ["It fell to 86.0%.", "The rest stayed."]):
        assert units(" ".join(parts), lang=lang) == parts


def test_a_passage_in_another_language_has_its_own_abbreviations():
    parts = ["The list was read by the office.", "Véase la pág. 25, núm. 3, de la nota.", "It was in the annex."]
    assert units(" ".join(parts), lang="en") == parts


def test_terminators_of_all_scripts():
    for parts in (["မင်္ဂလာပါ။", "နေကောင်းလား။"], ["សួស្តី។", "អរគុណ៕"], ["ሰላም ነው።", "ደህና ነህ፧", "አዎ፨"], ["ܫܠܡܐ܁", "ܐܢܐ܀"]):
        assert units(" ".join(parts)) == parts


def test_width_is_read_off_the_text():
    line = "the roster of this institute lists many more people than the one\n"
    text = line * 6 + "after that a line as long as the others ends before the word of\nKirchdorf, which goes on."
    assert len(units(text)) == 1 and wrap_width(line * 6 + line) in range(64, 69) and wrap_width("A line.\nB line.") == 0


def test_lists_without_marks_stay_linear():
    for t in ("item word and\n" * 8_000, "abc (def\n" * 8_000, "“open [x (y\n" * 8_000, "a." * 8_000 + " " * 8_000 + "x", "1. 2. a) " * 8_000):
        begin = time.perf_counter()
        sentence_spans(t, "en")
        assert time.perf_counter() - begin < 3
