import zipfile

import pytest

from lodestone.sources import archives, documents


@pytest.mark.parametrize(("page", "text"), [
    ("<body><nav>menu<p>Article one</p><p>two</p></body>", "menu\nArticle one\ntwo"),  # never closed: nothing is lost
    ("<div><nav>menu</div><p>Article</p>", "Article"), ("<div><header>top<span>x</div>Article<footer>f</footer>", "Article"),
    ("<p><nav></p>menu</nav>Article", "Article"), ("<nav>a<nav>b</nav>c</nav>d", "d"), ("</nav></div>a<br>b", "a\nb"), ("<nav>m<script>var x</script>n", "m\nn"),
    ("a<script>x", "a"), ("a<style>x</style><header>t</header>b", "a\nb"), ("<html><header>h<body>b</body></html>", "h\nb"), ("", ""),
])
def test_unclosed_elements(page, text):
    assert documents.html_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    ("<h1>a &amp; b&amp</h1>c", "a & b&amp\nc"), ("&lt;p&gt &copy;&copy &#65;&#x42; &amp;lt; &notit; & &&amp;", "<p&gt ©&copy AB &lt; &notit; & &&"),
    ("<p title='x&amp'>R&D</p>&amp", "R&D\n&amp"), ("<script>a&amp</script>b", "b"),
])
def test_references_end_in_a_semicolon(page, text):
    assert documents.html_text(page) == text
    assert archives.section_of(page, "x.html")[2] == " ".join(text.split())


def test_long_pages_of_unclosed_elements():
    assert documents.html_text("<p>x" * 50_000 + "</b>" * 10) == "\n".join(["x"] * 50_000)


@pytest.mark.parametrize(("page", "name", "want"), [
    ("<h1>Title</h1><h2>IC 35-42-1-1 Murder</h2><p>1. x</p><p>Sec. a</p>", "t/a/x.html", ("IC 35-42-1-1 Murder", "Sec. a", "Title IC 35-42-1-1 Murder 1. x Sec. a")),
    ("<nav><h2>IC 1</h2></nav><h4>Catch <b>line</b></h4>body\n  text", "t/a/IC_35-42-1-2.html", ("IC 35-42-1-2", "Catch line", "Catch line body text")),
    ("<p>one<p>two", "x.html", ("", "one", "one two")), ("", "12-3.html", ("IC 12-3", "", "")), ("<p>9<h3>ic  7</h3>", "a", ("ic  7", "", "9 ic 7")),
    ("<h1>so pathetic 4650831781109601</h1><h2>Public 12 (IC 5-1)</h2>", "IC_35-42-3.html", ("Public 12 (IC 5-1)", "", "so pathetic 4650831781109601 Public 12 (IC 5-1)")),
    ("<h1>so pathetic 4650831781109601</h1>", "IC_35-42-3.html", ("IC 35-42-3", "", "so pathetic 4650831781109601")),
])
def test_section_of(page, name, want):
    assert archives.section_of(page, name) == want


def test_archives_are_read_by_entry(spark, tmp_path):
    body = "<p>Words of the section, thirty or more of them.</p>"
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(600):
            z.writestr(f"title{35 + k % 2}/article{k % 3 or ''}/c/IC_1-{k}.html", body)
        z.writestr("title35/article1/short.html", "<p>short</p>")
        z.writestr("title35/readme.txt", body)
        z.writestr("title36\\article9\\IC_2-2.html", body)
    (tmp_path / "b.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("title35/article1/IC_3-1.html", body)
    data = (tmp_path / "c.zip").read_bytes()
    (tmp_path / "c.zip").write_bytes(data.replace(b"thirty", b"THIRTY"))  # the checksum no longer fits
    zipfile.ZipFile(tmp_path / "d.zip", "w").close()
    paths = archives.archive_paths(spark, str(tmp_path))
    assert paths.count() == 4 and "content" not in paths.columns
    listed = archives.entries(paths)
    assert listed.where("error is null").count() == 604 and listed.where("name is not null").select("path", "part").distinct().count() == 4
    sections, bad = archives.statute_sections(paths, ["35"])
    rows = sections.collect()
    assert len(rows) == 300 and {r.title for r in rows} == {"35"} and {r.article for r in rows} == {"0", "1", "2"}
    assert sorted(r.path.rsplit("/", 1)[1] for r in bad.collect()) == ["b.zip", "c.zip"]
    every, _ = archives.statute_sections(paths)
    assert every.count() == 601 and every.where("article = '9' and title = '36'").count() == 1
    none, _ = archives.statute_sections(spark.createDataFrame([(None,)], "path string"))
    assert none.count() == 0
