import numpy as np
from llm.tables import DOC, documents, empty, read, with_clashes

from weftline.llm import grams, language as L


def test_fold_counts_letters_and_lines():
    f = grams.fold(["Ab, 12\n\nÉcole  ж", "", "中文字"])
    assert list(f.letters) == [2, 0, 6, 0, 3] and list(f.text_of) == [0, 0, 0, 1, 2] and list(f.number) == [0, 1, 2, 0, 0]
    whole = grams.fold(["a\nb", "c"], split=False)
    assert list(whole.letters) == [2, 1]


def test_sums_do_not_cross_lines():
    rng = np.random.default_rng(0)
    table = rng.normal(size=(1 << 10, 3)).astype(np.float32)
    table[0] = 0
    texts = ["abc def", "x", "", "langer Text mit Wörtern"]
    together = grams.line_sums(grams.fold(texts), table, (1, 3), 10, step=5)
    for t, row in zip(texts, together):
        assert np.allclose(row, grams.line_sums(grams.fold([t]), table, (1, 3), 10)[0], atol=1e-4)


def test_held_out_accuracy(spark, small):
    model, names = L.fit_languages(read(spark, small, "documents"), read(spark, small, "langs"))
    assert model.report["accuracy"] >= 0.97 and model.report["zero_share"] > 0.3 and 0.04 < model.temperature < 20
    assert names["eng"] == "en" and names["german"] == "de"


def test_labels():
    names = {"en": "en", "eng": "en", "english": "en", "zh": "zh"}
    for label, want in {"EN": "en", "en-AU": "en", "en_GB": "en", "eng": "en", "English": "en", "zh-Hans": "zh", "und": None, "": None, None: None, "unknown": None, "nl": None, " en ": "en"}.items():
        assert L.label_code(names, label) == want


def cases(spark):
    en = "Records kept by sailors mention a copper bridge, an old mill and many coins beside the river."
    de = "Die Weber sagen, der Steinturm sei nach dem Hochwasser am östlichen Hang verlassen geworden."
    return documents(
        spark,
        [
            {"doc_id": 1, "text": f"{en}\n{en}\n{de}", "lang": "en"}, {"doc_id": 2, "text": f"{de}\n{de}", "lang": "EN"}, {"doc_id": 3, "text": de, "lang": None}, {"doc_id": 4, "text": "short", "lang": None},
            {"doc_id": 5, "text": None, "lang": "xx"}, {"doc_id": 6, "text": "", "lang": "de"}, {"doc_id": 7, "text": de, "lang": "deu"}, {"doc_id": 7, "text": de, "lang": "de_AT"},
            {"doc_id": 8, "text": "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor", "lang": "und"}, {"doc_id": None, "text": de, "lang": ""},
            {"doc_id": 9, "text": "{{ some.long.template.field_name_of_page }} {{ another_long_field_name }}", "lang": None}, {"doc_id": 10, "text": f"{de} " * 20000, "lang": "fr"},
        ],
    )


def test_cases(spark, small):
    langs = read(spark, small, "langs")
    model, _ = L.fit_languages(read(spark, small, "documents"), langs)
    for df in (cases(spark), with_clashes(cases(spark))):
        got = {(r.doc_id, r.line_no, r.lang) for r in L.languages(df, langs, model, every=False).collect()}
        assert got == {(1, 2, "de"), (2, -1, "de"), (3, -1, "de"), (None, -1, "de"), (10, -1, "de")}
        every = L.languages(df, langs, model).collect()
        assert {r.doc_id for r in every} == {1, 2, 3, 7, None, 10} and all(0 <= r.confidence <= 1 for r in every)


def test_nothing_to_learn_from(spark, small):
    langs = read(spark, small, "langs")
    assert L.wrong_languages(empty(spark, DOC), langs).count() == 0
    assert L.wrong_languages(documents(spark, [{"doc_id": 1, "text": "a text", "lang": None}]), langs).count() == 0
    assert L.wrong_languages(cases(spark), langs.limit(0)).count() == 0


def test_bare_lines_of_any_length():
    from weftline.llm.language import _bare

    for line in ("text " * 400, "{{first_name}} " * 50, "sample text " * 90, "${a} %%B%% <%= c %>"):
        assert _bare(line), line[:30]
    for line in ("the mill stood by the river " * 20, "no no", "a field written as {{ title }} is replaced by the name of the bridge"):
        assert not _bare(line), line[:30]
