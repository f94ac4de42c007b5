from gaugework.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">Advert text that is long enough to matter</div>
<div class="{main}"><h1>Title {n}</h1><p>First  paragraph
of {n} words &amp; more &lt;tags&gt; <a href="q>z">linked</a> te<b>xt</b>.<p>Second<br>one</div>
<div class="{other}">{side}</div><div id="comments"><p>A reader says so</p></div><form><label>Name</label></form><footer>&copy; foot</footer>"""


def page(n, side="short", main="story s12", other="box"):
    return PAGE.format(n=n, side=side, main=main, other=other)


def text(n):
    return f"Title {n} First paragraph of {n} words & more <tags> linked text. Second one"


def rows(spark, pages):
    return spark.createDataFrame([(i, u, b, "x", "y") for i, u, b in pages], "page_id long, url string, html string, text string, h string")


def test_hosts_agree_on_a_path(spark):
    noise = " ".join(["noise"] * 80)
    pages = [(i, f"http://A.example.org/{i}", page(i, main=f"story s{i}")) for i in range(6)]
    pages += [(10, "https://a.example.org:8080/z", page(10, side=noise)), (11, "http://b.example.org/", page(11, side=noise))]
    got = {r["page_id"]: r for r in h.extracted(rows(spark, pages)).collect()}
    assert all(got[i]["text"] == text(i) for i in range(6))
    assert got[10]["text"] == text(10)  # the host's path, not the page's longest container
    assert got[11]["text"] == noise  # a page alone has no other witness
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert h.extracted(rows(spark, pages)).columns == ["page_id", "url", "text", "n_chars"]


def test_markup():
    assert h.main_text(page(1), []) == text(1)
    assert h.main_text("<p>a<p>b <script>x</p>", []) == "a b"
    assert h.main_text("3 < 4 and <b>bold</i> &nbsp; &eacute;&#x1F600; &am", []) == "3 < 4 and bold é\U0001F600 &am"
    assert h.main_text("<div hidden>no</div><div role='navigation'>no</div><article><aside>no</aside>yes<table><tr><td>c1<td>c2</table></article>", []) == "yes c1 c2"
    assert h.main_text('<article><p title="a>b">kept</p></article>', []) == "kept"
    assert h.main_text("<article>one<!-- open comment", []) == "one"
    assert h.main_text("<body><main><span class='share'>no</span>yes <em>and</em> on</main>", []) == "yes and on"


def test_edges(spark):
    long = "<article>" + "<p>word " * 30_000 + "</article>"
    pages = [(1, None, None), (2, None, ""), (None, "not a url", "<p>text</p>"), (4, "http://h/", long), (5, "http://h/", "<" * 5_000),
             (6, "http://h/", "<script>only()</script>"), (7, "http://h/", "<a " + "'" * 3_001), (8, "http://h/", "<div>" * 3_000 + "deep")]
    got = {r["page_id"]: r["text"] for r in h.extracted(rows(spark, pages)).collect()}
    assert got[1] == got[2] == got[6] == "" and got[None] == "text" and got[4] == " ".join(["word"] * 30_000) and got[8] == "deep"
    assert got[5] == "<" * 5_000
    assert h.extracted(rows(spark, [])).collect() == []
    twice = h.extracted(rows(spark, [(1, "http://h/", "<p>a</p>")] * 2)).collect()
    assert [r["text"] for r in twice] == ["a", "a"]


def test_a_wrapper_named_after_a_sidebar_keeps_its_article():
    body = "<p>" + "word " * 30 + "</p>"
    text = " ".join(["word"] * 30)
    side = "<div class='sidebar'>side text</div>"
    assert h.main_text(f"<div class='content-sidebar-wrap'><main>{body}</main>{side}</div>", []) == text
    assert h.main_text(f"<div class='layout has-sidebar'><article>{body}</article>{side}</div>", []) == text
    assert h.main_text(f"<div id='page' class='site no-sidebar'><div>{body}</div>{side}</div>", []) == text
    assert h.main_text(f"<div class='widget-page'><div class='text'>{body}</div>{side}</div>", []) == text
    # what is no wrapper of the article still goes, articles of its own or not
    remark = "<article class='comment'><p>" + "remark " * 40 + "</p></article>"
    assert h.main_text(f"<main>{body}<div id='comments'>{remark}</div></main>", []) == text
    assert h.main_text(f"<main>{body}<div class='related'><article><p>teaser</p></article></div></main>", []) == text
    assert h.main_text(f"<body><div>{body}</div><div id='comments'>{body}{body}</div></body>", []) == text


def test_an_article_of_several_containers_is_whole(spark):
    one, two = "one " * 60, "two " * 40
    parts = f"<h1>Title</h1><p>lead</p><section><p>{one}</p></section><section class='b'><p>{two}</p></section>"
    text = " ".join(["Title lead", one.strip(), two.strip()])
    rail = "<div class='rail'><a href='/x'>linked words of a rail</a></div>"
    assert h.main_text(f"<body><div><article>{parts}</article>{rail}</div></body>", []) == text
    assert h.main_text(f"<body><main><div>{parts}</div></main>{rail}</body>", []) == text
    assert h.main_text(f"<body><div class='story'>{parts}</div>{rail}</body>", []) == text
    assert h.main_text(f"<div><div class='story'><div>{one}</div><div>{two}</div></div></div>", []) == f"{one}{two}".strip()
    assert h.main_text(f"<body><div>{one}</div><div>{two}</div></body>", []) == one.strip()  # the body is no article
    pages = [(i, f"http://h/{i}", f"<body><article>{parts}</article>{rail}</body>") for i in range(3)]
    assert {r["text"] for r in h.extracted(rows(spark, pages)).collect()} == {text}


def test_nothing_of_the_article_is_lost_behind_open_elements():
    assert h.main_text("<article><p>one</p><datalist><option value=a><option>b</datalist><p>second part</p></article>", []) == "one second part"
    assert h.main_text("<article><p>one <select><option>x<option>y</select> two</p><select><option>z<p>three</p></article>", []) == "one two three"
    assert h.main_text("<article><p>one <button><b>press</b></button> two</p><canvas><p>three</p></article>", []) == "one two three"
    assert h.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><object>shown instead</object></article>", []) == "Let x=2 hold. shown instead"
    assert h.main_text("<article><iframe>frame</iframe><p>one</p><textarea>typed</article>", []) == "one typed"


def test_names_inside_an_article_have_to_say_nothing_else():
    words = " ".join(["word"] * 40)
    for name in ("related-work", "comment-analysis", "share-price", "page-header-title"):
        assert h.main_text(f"<article><p>{words}</p><div class='{name}'><p>kept</p></div></article>", []) == f"{words} kept", name
    for name in ("share-buttons", "related-posts", "ad", "social_links", "newsletterSignup"):
        assert h.main_text(f"<article><p>{words}</p><div class='{name}'><p>gone</p></div></article>", []) == words, name
