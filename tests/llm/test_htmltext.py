import pytest

from landgauge.llm.htmltext import extract, html_to_text
from .conftest import SMALL

CASES = [
    (None, ""),
    ("", ""),
    ("plain", "plain"),
    ("<p>a <b>b</b>c<p>d", "a bc\n\nd"),
    ("<title>t</title><h1>H</h1>x<script>var a='<p>no</p>'</script><style>p{}</style><!-- c -->", "H\n\nx"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>after", "- one\n- two\n  - in\n- three\n\nafter"),
    ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
    ("<table><tr><th>name<th>n<tr><td>alpha<td>1<tr><td>b<td>22</table>", "name   n\nalpha  1\nb      22"),
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
    ("<table><tr><td colspan=2>wide cell<tr><td>x<td>y</table>", "wide cell\nx  y"),
    ("<td>cell without a table", "cell without a table"),
    ("<div hidden>x</div><div style='display: none'>y</div><div style='visibility:hidden'>z<b style='visibility:visible'>seen</b></div>", "seen"),
    ("<style>.h, #i {display:none}</style><p class='a h'>no<p id=i>no<p>yes", "yes"),
    ("<pre>\n a\n  b</pre>", " a\n  b"),
    ("<details><summary>s</summary>body</details><details open>t</details>", "s\nt"),
    ("<dl><dt>term<dd>meaning<dt>two<dd>m2</dl>", "term\n  meaning\ntwo\n  m2"),
    ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"),
    ("&lt;b&gt; &amp; &copy;&nbsp;1 &#233;", "<b> & © 1 é"),
    ("<input type=hidden value=x><input type=submit value=Go><option>o", "Go\no"),
    ("x</p>y</b></div></table>z", "x\n\nyz"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("a < b and c <", "a < b and c <"),
    ("<p>unclosed <i>markup <p>next", "unclosed markup\n\nnext"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_layout(html, text):
    assert html_to_text(html) == text


HIDE = ".h { display: none }"


@pytest.mark.parametrize(
    "sheet,hidden",
    [
        (HIDE, True),
        (f"@media print {{ {HIDE} }}", False),
        (f"@media (max-width: 600px) {{ {HIDE} }}", False),
        (f"@media only screen and (max-width:40em){{.x{{color:red}}{HIDE}}}", False),
        (f"@media screen and (orientation: landscape) {{ {HIDE} }}", False),
        (f"@media print {{ @supports (display: grid) {{ {HIDE} }} }}", False),
        (f"@media print {{ .x {{ color: red }} }} {HIDE}", True),
        (f"@media screen and (min-width: 600px) {{ {HIDE} }}", True),
        (f"@media print, screen {{ {HIDE} }}", True),
        (f"@media not print {{ {HIDE} }}", True),
        (f"@media not screen {{ {HIDE} }}", False),
        (f"@import url(x.css); @layer base {{ {HIDE} }}", True),
        (".x::before { content: '}' } @media print { .y { content: '{' } .h { display: none } }", False),
        (".h { color: red; @media print { display: none } }", False),
    ],
)
def test_conditional_rules_hide_only_what_a_screen_hides(sheet, hidden):
    assert html_to_text(f"<style>{sheet}</style><p class=h>menu<p>rest") == ("rest" if hidden else "menu\n\nrest")


def test_style_elements_for_other_media():
    assert html_to_text(f"<style media=print>{HIDE}</style><p class=h>menu") == "menu"
    assert html_to_text(f"<style media=screen>{HIDE}</style><p class=h>menu") == ""


def test_deep_nesting_and_huge_spans():
    assert html_to_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert html_to_text("<ul><li>" * 500 + "x").endswith("- x")
    assert html_to_text("<table><tr><td colspan=999999999 rowspan=999999999>a<td>b</table>").split() == ["a", "b"]


def test_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = extract(pages).collect()
    source = {r.page_id: r.html for r in pages.collect()}
    assert len(got) == len(source)
    for r in got:
        assert "var t=" not in r.text and "<p>" not in r.text and "\n\n\n" not in r.text
        title = source[r.page_id].split("<h1>")[1].split("</h1>")[0]
        if "&" not in title:
            assert " ".join(title.split()) in r.text
        if "<footer>" in source[r.page_id]:
            assert r.text.splitlines()[-1].startswith("©")


def test_odd_rows(spark):
    rows = [(None, None, "t"), (1, "<p>x", None), (1, "<p>x", None), (2, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in extract(pages).collect()) == [(0, ""), (1, "x"), (1, "x"), (2, "")]
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
