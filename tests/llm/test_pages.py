import random

from pyspark.sql import functions as F

from loam.llm import boilerplate, markup, residue

PAGE = """Home | Docs | Pricing
Home > Docs > How Vor handles nested lists
Accept all cookies

How Vor handles nested lists
The privacy setting hides nested lists from every auditor.
Rotate nested lists
Popular this week
Open tickets and the tax table
Kels usage meter guide
Copyright claims about slow queries go to the auditor in Ond.
How Ond handles slow queries
Tags: vor, kels
Page 2 of 5
© 2020 Vor. All rights reserved."""


def test_furniture_lines():
    lines = PAGE.split("\n")
    assert boilerplate.outside_lines(lines, None) == [1, 2, 3, 8, 9, 10, 13, 14, 15]
    assert boilerplate.outside_lines(["Menu text here.", ""], "x") == []


def test_furniture_of_other_sites():
    for line in ("We use cookies to improve your experience.", "Join our mailing list", "© 2024 Acme Inc.", "Deze website gebruikt cookies.", "Pagina 2 van 5", "Naar boven"):
        assert boilerplate.line_kind(line) == boilerplate.FURNITURE, line
    for line in ("Copyright claims about slow queries go to the auditor in Ond.", "The privacy setting hides nested lists from every auditor.", "To subscribe a team to alerts, open the query router and add its address."):
        assert not boilerplate.line_kind(line), line


def test_long_list_of_other_pages():
    entries = [f"How Vor handles topic {x}" for x in "abcdefgh"]
    lines = ["The title", "A sentence stands here.", "Read next", *entries]
    assert boilerplate.outside_lines(lines, "The title") == list(range(3, 12))


def test_render():
    page = "<html><head><title>x</title></head><body><p>a<p>b &amp; c<ul><li>one<li>two</ul><div hidden>no<p>no</div><table><tr><th>h<th>long<tr><td>1<td>2</table><script>x</script></body>"
    assert [x[0] for x in boilerplate.render(page)] == ["a", "", "b & c", "", "- one", "- two", "", "h  long", "1  2"]
    assert [x[0] for x in boilerplate.render("<p>a</i></b> b<br>c</p></div><pre>x\n  y</pre><table><tr><td><p>in</p><p>cell</p></table>")] == ["a b", "c", "", "x", "  y", "", "in cell"]


def test_rendered_lines_are_numbered_as_in_the_source():
    page = "<body>\n<nav><a>Anything</a> <a>at all</a></nav>\n<h1>The title</h1>\n<p>A sentence\nover two lines.</p>\n<footer>\nWho made this\n</footer>\n</body>"
    assert boilerplate.furniture_numbers(page, "The title") == [2, 7]
    assert boilerplate.main_body(page, "The title").split("\n") == ["The title", "", "A sentence over two lines."]


def test_lines_that_pages_share(spark):
    pages = [(i, f"Gadget corner {i}\nPeek at the basket\nPage about thing {i}\nIt explains thing {i}.\nKeep in touch with Alpha", f"Page about thing {i}", f"www.alpha{i % 3}.example") for i in range(40)]
    df = spark.createDataFrame(pages, "doc_id long, text string, title string, site string")
    found = boilerplate.furniture_lines(df, "doc_id", "text", "title")
    assert {r.line_no for r in found.collect()} == {1, 2, 5} and found.count() == 120


def test_learnt_lines_beyond_those_shipped(spark, monkeypatch):
    text = "Gadget corner {i}\nPeek at the basket\nWander off | Odd corner | Blue door\nEver more oddities\nPage about thing {j}\nPage about thing {i}\nIt explains thing {i}.\nKeep in touch with Alpha"
    pages = [(i, text.format(i=i, j=(i + 1) % 40), f"Page about thing {i}", f"www.alpha{i % 3}.example") for i in range(40)] + [(0, "x", None, None), (None, None, "t", "s")]
    df = spark.createDataFrame(pages, "doc_id long, text string, title string, site string")
    lines = sorted(map(tuple, boilerplate.furniture_lines(df, "doc_id", "text", "title").collect()))
    bodies = sorted(map(repr, boilerplate.main_texts(df, "doc_id", "text", "title").collect()))
    assert {n for _, n in lines} == {1, 2, 3, 4, 5, 8}
    for shipped in (0, 3):
        monkeypatch.setattr(boilerplate, "MODEL_LINES", shipped)
        assert sorted(map(tuple, boilerplate.furniture_lines(df, "doc_id", "text", "title").collect())) == lines
        model = boilerplate.line_model(df)
        assert len(model.kinds) == shipped and model.rest.count() > 0
        assert sorted(map(repr, boilerplate.main_texts(df.repartition("doc_id"), "doc_id", "text", "title", model=model).collect())) == bodies


def test_page_operator_on_odd_rows(spark):
    rows = [(1, PAGE, None, 9), (1, PAGE, None, 9), (2, None, None, 9), (3, "", "t", 9), (4, "x\n" * 50_000, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string, line_no int")
    assert boilerplate.furniture_lines(df, "doc_id", "text", "title").distinct().count() == 9
    bodies = {r.doc_id: r.main_text for r in boilerplate.main_texts(df, "doc_id", "text", "title").collect()}
    assert bodies[2] == "" and bodies[1].startswith("How Vor") and boilerplate.furniture_lines(df.limit(0), "doc_id", "text", "title").count() == 0


NOTATIONS = {
    "html": ("<!DOCTYPE html><html><head><script>var n; // <h2>no</h2>\n</script></head><body><H1\n id='a'>Top <b>one</b></H1><!-- <li>no</li> --><ul><li>first<li>a &amp; <code>b</code></ul><pre>x &lt; 1\n  y</pre><p>see \\(a+b\\)</p><div class='math'>\\[c &gt; d\\]</div>",
             {("heading", "Top one"), ("list_item", "first"), ("list_item", "a & b"), ("code", "x < 1 y"), ("formula", "a+b"), ("formula", "c > d")}),
    "markdown": ("Top `one`\n=====\n\n- [x](u) first\n- **second** ~~z~~\n\n    code = 1\n\n~~~sh\n# no\n~~~\n\nCosts $ 8 or $ 9, or $5 and $6. Here $a_{1}$ holds.\n\n$$\nb > c\n$$\n\n<!-- # no -->\n\n## Two ##\n\n3) third",
                 {("heading", "Top one"), ("heading", "Two"), ("list_item", "x first"), ("list_item", "second z"), ("list_item", "third"), ("code", "code = 1"), ("code", "# no"), ("formula", "a_{1}"), ("formula", "b > c")}),
    "wiki": ("{{Infobox x|a=b}}\n== Top ''one'' ==\n# [[a|first]]\n** [http://x second]<ref>no</ref>\n<pre>x &lt; 1</pre>\n: <math>a &gt; b</math>\n{| class=\"t\"\n! p\n|}\n[[Category:No]]\n<!-- == no == -->",
             {("heading", "Top one"), ("list_item", "first"), ("list_item", "second"), ("code", "x < 1"), ("formula", "a > b")}),
    "latex": ("\\documentclass{a}\n% \\section{no}\n\\begin{document}\n\\section*{Top \\emph{one}}\\label{s}\n\\begin{itemize}\n  \\item \\href{u}{first} 5 \\%\n  % \\item no\n  \\item second~\\cite{x}\n\\end{itemize}\n\\begin{verbatim}\n% x\n\\end{verbatim}\nCosts \\$ 5. Here $a$ and \\[b\\] hold.\n\\end{document}",
              {("heading", "Top one"), ("list_item", "first 5 %"), ("list_item", "second"), ("code", "% x"), ("formula", "a"), ("formula", "b")}),
}


def test_elements_of_every_notation():
    for name, (text, want) in NOTATIONS.items():
        assert markup.notation(text) == name
        assert {b for b in markup.blocks(text) if b[0] != "paragraph"} == want, name


def test_element_operator_on_odd_rows(spark):
    rows = [(1, NOTATIONS["wiki"][0], "a"), (1, NOTATIONS["wiki"][0], "a"), (2, None, "a"), (3, "", None), (4, "# h\n\n" + "word " * 100_000, None), (5, "<<<>>> &#xZZ; [[ {{ $ \\begin{", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, element string")
    got = {r.doc_id: r["count"] for r in markup.elements(df).groupBy("doc_id").count().collect()}
    assert got[1] == 10 and got[4] == 1 and 2 not in got and markup.elements(df.limit(0)).count() == 0
    assert {r.doc_id: r.clean_text for r in markup.cleaned(df).collect()}[2] == ""


def test_content_region():
    word, tag = markup.fit_weights([([True, False, False, True, False], [False, True, True, False, True])])
    assert word > 0 > tag
    assert markup.content_region([-1, 2, -1, 3, -5, 3]) == (1, 4) and markup.content_region([-1.0]) == (0, 0) and markup.content_region([]) == (0, 0)
    rng = random.Random(3)
    for _ in range(300):
        x = [rng.choice([-2, -1, 1, 2]) for _ in range(rng.randrange(1, 12))]
        a, b = markup.content_region(x)
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])


def test_region_leaves_out_head_and_keeps_every_element():
    html = NOTATIONS["html"][0]
    a, b = markup.content_bounds(html)
    assert "script" not in html[a:b] and html[a:b].startswith("<H1")
    latex = NOTATIONS["latex"][0]
    a, b = markup.content_bounds(latex)
    assert "documentclass" not in latex[a:b] and "end{document}" not in latex[a:b]
    for text, want in NOTATIONS.values():
        assert {x for x in markup.region_blocks(text) if x[0] != "paragraph"} == want
    assert markup.label("# no body") is None and markup.content_bounds("") == (0, 0)


RESIDUE = [
    (1, "note", "Dear {{name}}, hello.", True), (2, "note", "The marker `{{name}}` is replaced.", False), (3, "note", "Access denied, reference 9df95046. HTTP 504 - bad gateway.", True),
    (4, "note", "Access denied, reference 9df95046. Set the limit to 3 and restart it.", False), (5, "note", "TODO: describe lists here.", True), (6, "note", "Lorem ipsum horas faciet tarda augur. Real text.", True),
    (7, "note", "Designers once used words such as lorem ipsum in mock-ups.", False), (8, "page", "Home | Docs | Blog\nTitle X\nYou must turn on JavaScript to continue.\nBack to top", True),
    (9, "page", "Title X\nSome features of this site need JavaScript.\nSet the limit to 3 and restart the audit log.", False), (10, "export", "# T\n\nBitte aktivieren Sie JavaScript, um fortzufahren.", True),
    (11, "export", "<p>Le contrat avec &lt;&lt;plan&gt;&gt; prend fin.</p>", True), (12, "export", "# T\n\n```\necho ${X}\n```\n\nText is here.", False), (13, "note", 'The message "Access denied." is shown by old browsers only.', False),
    (14, "note", None, False), (15, "note", "", False), (16, None, "Regards from XXXX and the team.", True), (17, "note", "状态504：拒绝访问。", True),
    (18, "note", "Hello {first_name}, it is ready.", True), (19, "note", "与[[order_no]]签订的合同月底到期。", True), (20, "page", "Title X\nDear $CUSTOMER_NAME, it is ready.", True),
    (21, "export", "{{Infobox x|a=b}}\n== T ==\nSee [[Plan]] and [[Kels|receipts]], they are ready.", False), (22, "export", "\\section{T}\n\\textbf{bold} text is here, $X_{max}$ too.", False), (23, "note", "Title X\n\nError 404: not found.", True),
    (24, "page", "Home\n" * 900 + "Title X\nAccess denied, reference 9df95046.", True), (25, "note", "Teams have 345 nodes. They hold long tables.", False),
]


def test_residue(spark):
    df = spark.createDataFrame([(i, t, k, "Title X", "s", "n") for i, k, t, _ in RESIDUE], "doc_id long, text string, kind string, title string, source string, reason string").withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in residue.residue(df.unionByName(df)).collect()} == {i for i, _, _, case in RESIDUE if case}
    assert residue.residue(df.limit(0)).count() == 0
    assert residue.normalise("Error 5 at 2024-01-02, see https://a.b/c or X@y.ex") == "error <n> at <date>, see <url> or <mail>" and residue.normalise("HTTP 504 - bad") == "http <status> - bad"


def test_sentences_are_split_only_where_filler_may_stand(monkeypatch):
    latin = residue._LATIN | {"but", "now", "real"}
    split = []
    monkeypatch.setattr(residue, "sentences", lambda text, lang: split.append(text) or [(0, len(text))])
    plain = "Teams hold long tables, but the real ones are now short.\n\nLists now grow."
    for kind in ("note", "page", "export"):
        assert residue.messages(plain, kind, "T", "en", latin) == ([], []) and not split, kind
        assert residue.messages(plain + "\n\nReal dolor vitae elit now.", kind, "T", "en", latin)[0] == ["real dolor vitae elit now."], kind
        split.clear()


def test_filler_test_holds_for_every_filler_sentence():
    rng = random.Random(7)
    pools = [["dolor", "elit", "magna"], ["et", "in"], ["foo", "blah"], ["list", "team", "x"], ["lorem", "ipsum"]]
    found = 0
    for _ in range(20_000):
        some = [w for pool in rng.sample(pools, rng.randint(1, 3)) for w in pool]
        words = [rng.choice(some) for _ in range(rng.randint(1, 12))]
        if residue._filler(" ".join(words), residue._LATIN):
            found += 1
            assert residue._has_filler_run(" ".join(["team", *words, "list"]), residue._LATIN), words
    assert found > 2_000


def test_faster_patterns_accept_the_same():
    terms = residue._TERMS.split("|")
    assert all(residue._TERM.search(f"x{t}y") for t in terms) and not residue._TERM.search("teams hold long tables")
    rng = random.Random(8)
    for _ in range(20_000):
        t = rng.choice(terms)
        text = t[: rng.randint(0, len(t))] + rng.choice(terms)[rng.randint(0, 4) :]
        assert bool(residue._TERM.search(text)) == any(x in text for x in terms), text
    fields = ["{{name}}", "\\{\\{ a.b \\}\\}", "${x}", "\\$\\{x}", "[INSERT date]", "[Your name]", "XXXX", "#NAME#", "<<plan>>", "&lt;&lt;plan&gt;&gt;", "{% x %}", "\\{\\% x \\%\\}", "__NAME__", "\\_\\_NAME\\_\\_", "@@x@@", "*|NAME|*", "%NAME%", "%%NAME%%", "$NAME", "[[order_no]]"]
    for form in (None, "wiki"):
        assert {residue._mark_fields(f"Dear {x} and", form) for x in fields} == {f"Dear {residue._MARK} and"}
    assert residue._mark_fields("See [[Plan]].", "wiki") == "See [[Plan]]." and residue._mark_fields("See [[Plan]].", None) == f"See {residue._MARK}."
