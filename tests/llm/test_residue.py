import pytest

from glossaflow.llm import residue as R

BAD = [
    "Title: {{title}}", "Loss of {pub_date} slowed", "Doi: <%= doi %>", "x %drug_name% y", "$sponsor$", "@@doi@@", "«drug_name» worsened", "[[doi]]", "__title__の", "&lt;abstract&gt; preceded", "<your doi>", "[INSERT SPONSOR HERE]", "[outcome to be added]", "#{doi}", "${sponsor}",
    "Lorem ipsum dolor", "Dolor ipsum sit elit magna, sed", "xxxxx xxxx xxxxxxx xx", "TBD TBD TBD", "TODO: write title", "Sample text.", "Type the doi here.", "Texte à compléter.", "Text folgt in Kürze.", "Aquí va el resumen.", "Вставьте текст аннотации", "此处填写摘要内容。", "ここに要旨を入力してください。", "यहाँ सार लिखें",
    "404 Not Found", "HTTP/1.1 503 Unavailable", "Error 404: the article you requested does not exist", "Forbidden [status 403]", "Status: 503. Unavailable.", "Page not found", "Your session has expired. Please sign in again", "You must sign in to see this record", "Access denied: subscription required", "The link to this page has expired", "Seite nicht gefunden (Fehler 404)",
    "La página solicitada no existe", "Cette page est introuvable", "Страница не найдена", "页面不存在或已被删除", "ページが見つかりません", "Fatal error: undefined variable $x", "article.body is not set", "Too many requests – please try again later",
    "Please enable JavaScript to view this article.", "NOSCRIPT: TURN ON SCRIPTS", "This page requires JavaScript and cookies.", "Bitte aktivieren Sie JavaScript", "Veuillez activer JavaScript", "Active JavaScript para continuar.", "Включите JavaScript, чтобы", "请启用浏览器的脚本功能", "JavaScriptを有効にして", "Scripts are blocked.",
]
GOOD = [
    "The script of the interview required cookies and tea for rats.", "Template-based modelling of X was scripted in JavaScript.", "Our cohort of 404 donors had residue 404.", "A 404-bp product of X was cloned.", "The set {0, 1} was used to code X.", "[Ca2+] rose at <0.5 mM and >20% of wells.", "Costs were $3.50 per dose and $4 per visit of $110.",
    "In 3 audits the server was not available and the page was not found in the paper file.", "Access was denied to 3 centres by the board.", "Readers made errors in 4 of 9 slides.", "We analysed how often health sites return “page not found” to patients.", "Placeholder tablets of X looked the same as the active drug.", "Of the templates tested, 3 gave no product.",
    "Error bars show 95% limits of X.", "Sessions that expired were repeated.", "el dolor de la señal, el dolor", "« Est-ce que X est sûr ? »", "(p < 0.05) x<sub>2</sub>", "", "  ",
]


@pytest.mark.parametrize("text", BAD)
def test_evidence(text):
    for t in (text, text.upper() if "{%" not in text else text, "Some real content here. " + text, "Loss of X… " + text):
        assert R.pieces(t), t


@pytest.mark.parametrize("text", GOOD)
def test_proper_text(text):
    assert R.pieces(text) == []


def test_rows_and_boilerplate(spark):
    furniture = "Enable JavaScript for comments"
    docs = [(k, f"Text {k} is real.\n{furniture}", "host", "x") for k in range(40)] + [(100, furniture, None, "x"), (101, "404 Not Found", "host", "x"), (101, "404 Not Found", "host", "x"), (102, None, "host", "x"), (103, "", None, "x"), (104, "a " * 100_000 + "{{doi}}", "host", "x"), (105, f"Page not found\n{furniture}", "host", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, evidence string")
    assert sorted(r.doc_id for r in R.residue(df).collect()) == [100, 101, 104, 105]
    assert R.without_residue(df).where("doc_id < 100").count() == 40
    assert R.residue(df.where("false")).count() == 0
