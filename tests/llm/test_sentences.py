import pytest

from loam.llm.sentences import language, sentence_units, sentences

CASES = [
    ("en", "Mr. A. D. Ushs of Vork Inc. signed. It cost 3.5 % i.e. little! iRoute 9.1 fixed No. 8 here.", 3),
    ("en", "“We lost pages. We found them.” said Ulm. Next one.", 2), ("en", "(A note is old.) Wait ... is it safe?! Yes", 3), ("en", 'He asked, "Who owns it?" and left. “Never merge!” Go on.', 3),
    ("en", "Open at 6:30 p.m. The team left, etc. Nobody knew… Our test ran.", 4), ("en", "See https://a.b/c?x=1 or mail x@y.example now.", 1), ("en", "one line\nwraps here. Next", 2), ("en", "no end\n\nnew one", 2),
    ("de", "Am 2. Mai prüft Dr. Ith alles, d. h. z. B. Belege usw. Das Archiv läuft ca. 3 Std. und ruht.", 2), ("de", "„Das geht so nicht.“, schrieb Daxm zu Nr. 8. Danach kam nichts.", 2),
    ("fr", "Voir p. 63, art. 25 : ici. « Rien ne marche. » fut la réponse de M. Brel. N’effacez jamais !", 3), ("es", "La Sra. Ushs firma, p. ej., los recibos. ¡No borre nunca! ¿Qué pasa?", 3),
    ("zh", "“审计日志坏了。”负责人写道：“坏了。请重启。”然后关闭了工单。平均3.5秒。查询路由……会合并。", 4), ("ja", "票には「止まった。再起動した。」と書かれている。「確認しません。」Cors 3.8.8では消す！", 3),
    ("hi", "डॉ. ओमिस के अनुसार। कौन देखता है? 3.5 सेकंड में।", 3), ("ar", "من يعالج؟ خلال 3.5 ثانية، ثم تتوقف.", 2), ("ko", "기록은 보관한다. 누가 처리합니까? 3.5초 안에 합친다.", 3),
    ("th", "บันทึกตรวจสอบใช้เวลา 51.7 วินาทีในการรวม งานออกบิลปฏิเสธตาราง\n\nดัชนีค้นหารวมทุกคืน", 3), (None, "", 0), (None, "   \n\n ", 0), ("und", "x", 1),
]


@pytest.mark.parametrize(("lang", "text", "n"), CASES)
def test_counts_and_cover(lang, text, n):
    spans = sentences(text, lang)
    assert len(spans) == n, [text[a:b] for a, b in spans]
    assert all(text[a:b] == text[a:b].strip() and a < b for a, b in spans) and all(p[1] <= q[0] for p, q in zip(spans, spans[1:]))
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())


def test_tables_and_code_are_left_out():
    text = "First one.\n\n| a. B | c |\n\n```\ncode. Here\n```\nLast one.\n~~~\nopen. End"
    assert [text[a:b] for a, b in sentences(text, "en")] == ["First one.", "Last one."]


def test_operator_on_odd_rows(spark):
    long = "This is it. " * 20_000
    rows = [(1, "A b. C d.", "EN", "x"), (1, "A b. C d.", "EN", "x"), (2, None, None, None), (3, "", "en", None), (4, long, None, None), (None, "One.", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, char_start string")
    out = sentence_units(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in out} == {1: 4, 4: 20_000, None: 1}
    assert sentence_units(df.limit(0)).count() == 0 and language("ZH-hans") == "zh" and language("xx") is None
