import random

from sluice.functions.html import main_text, page_links
from sluice.functions.markup import blocks, visible_text


def test_visible_text_lines():
    html = "<html><head><title>x</title></head><body><p>One <b>two</b>&nbsp;\n three<br>four<script>var a='</p>';</script><!-- no --><noscript>n</noscript><DIV>five &amp; six</DIV></body>"
    assert visible_text(html) == "One two three\nfour\nfive & six"


def test_empty_and_null():
    assert visible_text(None) == "" and visible_text("") == "" and visible_text("   ") == ""
    assert blocks("").blocks == [] and visible_text("plain text") == "plain text"


def test_sloppy_markup_terminates():
    random.seed(2)
    parts = ["<", ">", "<p", "<p class='", '"', "'", "<!--", "-->", "<script>", "</script>", "a", " ", "&amp", "<b>", "</div>", "<div id=x>", "é"]
    for _ in range(300):
        s = "".join(random.choice(parts) for _ in range(60))
        visible_text(s), main_text(s), page_links(s)
    assert visible_text("<p " * 50_000) is not None


def test_p_numbers_and_links():
    page = blocks("<P>a</P><div><p>b<p>c <a href=/x>link</a></div><noscript><p>z</noscript><p>d")
    assert [(b.text, b.p_no) for b in page.blocks if b.p_no] == [("a", 1), ("b", 2), ("c link", 3), ("d", 5)]
    assert page.n_p == 5
    assert [b.link_chars for b in page.blocks] == [0, 0, 4, 0]


def test_unquoted_and_odd_attributes():
    assert visible_text('<p title="a > b">x</p>') == "x"
    assert visible_text("<p title='it\"s'>x</p>") == "x"


def test_main_text_removal():
    html = '<body><nav>menu</nav><div class="Main-NavBar">bar</div><div class="ad">kept</div><article><p>a</p><p>b <i>c</i></p></article><footer>f</footer></body>'
    assert main_text(html) == "a\nb\nc"
    assert main_text("<body><p>x</p><div class=uploads>gone</div></body>") == "x"
    assert main_text("<main>m<aside>no</aside></main><article>a</article>") == "m"
    # A body of an unwanted class leaves only what is outside it.
    assert main_text('<html><head><title>T</title></head><body class="has-sidebar">x</body></html>') == "T"
    assert main_text("<p>a<nav>x", unwanted_tags=()) == "a\nx"
    assert main_text(None) is None and main_text("") == ""


def test_links_first_label_wins():
    html = '<a href="/a.pdf">One</a><a href="b">B <b>bold</b></a><a href="/a.pdf">Two</a><a name=x>no</a>'
    assert page_links(html, "https://h.example/d/") == [(0, "/a.pdf", "https://h.example/a.pdf", "One"), (1, "b", "https://h.example/d/b", "B bold")]
