"""Broken HTML, URLs by the examples of RFC 3986, stems by published pairs."""

import pytest
from pyspark.sql import functions as F

from ranklode.functions import html, parse, stem
from ranklode.functions import text as T


def links(s):
    return html.parse(s)[5]


def test_tokens_of_broken_pages():
    kinds = lambda s: list(html.tokens(s))
    assert kinds("a < b <3 <> </> c") == [("text", "a <"), ("text", " b <"), ("text", "3 <"), ("text", "> "), ("text", " c")]
    assert kinds("x<p") == [("text", "x")] and kinds("x<a href='1") == [("text", "x")] and kinds("x<!-- y") == [("text", "x"), ("comment", " y")]
    assert kinds("<!-->a<!--->b<!-- c --!>d") == [("comment", ""), ("text", "a"), ("comment", ""), ("text", "b"), ("comment", " c "), ("text", "d")]
    assert kinds("<!doctype html><?xml x?></ p>z") == [("comment", "doctype html"), ("comment", "xml x?"), ("comment", " p"), ("text", "z")]
    assert kinds("<P CLASS=a class=b checked data-x = 'y' / z=\"<>\">") == [("open", "p", {"class": "a", "checked": "", "data-x": "y", "z": "<>"})]
    assert kinds("<script>if (a</b>c) '</scripty>'</SCRIPT >d")[:2] == [("open", "script", {}), ("inside", "script", "if (a</b>c) '</scripty>'")]
    assert kinds("<style>never ends <b>") == [("open", "style", {}), ("inside", "style", "never ends <b>")]
    assert kinds("<title>a &amp; <b></title>") == [("open", "title", {}), ("inside", "title", "a & <b>"), ("close", "title")]
    assert kinds("") == [] and kinds("<") == [("text", "<")] and kinds("</") == [("text", "<"), ("text", "/")]


def test_links_and_references():
    assert links("<a href=/bare>x</a><A HREF='/one'>y <b>z</b></A><a\nid=1\thref = \"/two\">&eacute;&#233;&#xE9;</a>") == [("/bare", "x"), ("/one", "y z"), ("/two", "ééé")]
    assert links('<a href="?a=1&copy=2&amp;b=3&lt">x</a>') == [("?a=1&copy=2&b=3<", "x")]
    assert links("<a href=1>one<a href=2>two") == [("1", "one"), ("2", "two")] and links("<a name=x>no</a>") == []
    assert links('<iframe src="/f"></iframe><frame src=g>') == [("/f", ""), ("g", "")]
    title, text, description, keywords, base, _ = html.parse('<head><base href=/b/><meta name=Description content="d &gt; e"><meta name=keywords content=k><title> T </title></head><p>a&nbsp;b<br>c<script>no</script>d<!-- no --><p>&#0;&bogus; &amp')
    assert (title, description, keywords, base) == ("T", "d > e", "k", "/b/")
    assert text == "\na b\nc d\n�&bogus; &"


def test_pages_in_batches(spark):
    df = spark.createDataFrame([(1, "<title>t</title><p>x<a href=/y>z</a>"), (2, None), (3, "")], "k int, h string")
    got = {r.k: r for r in df.select("k", html.page("h").alias("p"), T.html_title("h").alias("t"), T.strip_html("h").alias("s"), F.size(T.html_links("h")).alias("n"), T.anchor_text("h").alias("a")).collect()}
    assert got[1].p.links[0].href == "/y" and (got[1].t, got[1].s, got[1].n, got[1].a) == ("t", "\nxz", 1, "z")
    assert got[2].p is None and got[2].t is None and got[3].t == "" and got[3].n == 0


RFC = {  # base http://a/b/c/d;p?q
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
    "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q",
    ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g",
    "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
    "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_resolved_urls(spark):
    df = spark.createDataFrame([*((k, "http://a/b/c/d;p?q", v) for k, v in RFC.items()), ("x/y", "http://h", "http://h/x/y"), ("?", "http://h/p?q", "http://h/p?"), (None, "http://h/", None)], "r string, b string, w string")
    wrong = [tuple(r) for r in df.select("r", "w", T.resolved_url("r", "b").alias("got")).collect() if r.w != r.got]
    assert wrong == []
    words = df.limit(1).select(T.url_words(F.lit("https://user@www.Ex-ample.com/a%20b/C_d.html?no#no"))).first()[0]
    assert words == ["ex", "ample", "com", "a", "b", "c", "d", "html"]


# Word and stem as the paper has them, step by step, where all steps leave the same.
PAIRS = """caresses caress  ponies poni  ties ti  caress caress  cats cat  feed feed  agreed agre  plastered plaster  bled bled  motoring motor  sing sing  conflated conflat  troubled troubl
sized size  hopping hop  tanned tan  falling fall  hissing hiss  fizzed fizz  failing fail  filing file  happy happi  sky sky  relational relat  conditional condit  rational ration
valenci valenc  hesitanci hesit  digitizer digit  conformabli conform  radicalli radic  differentli differ  vileli vile  analogousli analog  vietnamization vietnam  predication predic
operator oper  feudalism feudal  decisiveness decis  hopefulness hope  callousness callous  formaliti formal  sensitiviti sensit  sensibiliti sensibl  triplicate triplic  formative form
formalize formal  electriciti electr  electrical electr  hopeful hope  goodness good  revival reviv  allowance allow  inference infer  airliner airlin  gyroscopic gyroscop
adjustable adjust  defensible defens  irritant irrit  replacement replac  adjustment adjust  dependent depend  adoption adopt  homologou homolog  communism commun  activate activ
angulariti angular  homologous homolog  effective effect  bowdlerize bowdler  probate probat  rate rate  cease ceas  controll control  roll roll""".split()


@pytest.mark.parametrize(("word", "want"), list(zip(PAIRS[::2], PAIRS[1::2], strict=True)))
def test_stems(word, want):
    assert stem.stem(word) == want


def test_stems_of_texts(spark):
    df = spark.createDataFrame([("The Ponies' relational motoring, of course: naïve é 12", 1), (None, 2), ("", 3)], "t string, k int")
    got = {r.k: r.s for r in df.select("k", parse.porter_stemmed("t", ["The", "of"]).alias("s")).collect()}
    assert got[1] == "poni relat motor cours na ve 12" and not got[2] and got[3] == ""
    assert [stem.stem(x) for x in ("", "is", "naïve", "A1", "ion", "yes", "eed")] == ["", "is", "naïve", "A1", "ion", "ye", "eed"]
