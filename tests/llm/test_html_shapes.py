"""Pages that are not made by the training generator, an independent reader of well-formed ones, and growth."""

import time
from html.parser import HTMLParser

from sievecraft.llm.html_blocks import blocks
from sievecraft.llm.html_extract import default_field, main_text, op8_html_extract

SF = "/root/testdata/sf0.001"


def texts(page):
    return [b.text for b in blocks(page)]


def test_quotes_references_and_controls():
    assert texts("<div data-x=it's><p>first para</p></div><p>second para isn't</p><p>third</p>") == ["first para", "second para isn't", "third"]
    assert texts('<p title="x>two</p>') == ["two"]
    assert texts("<p title='a>b'>one</p><p title = x>two<p title>three") == ["one", "two", "three"]
    assert texts("AT&<b>amp;</b> &amp;lt; &copy &#65;") == ["AT&amp; &lt; © A"]
    assert texts("a<button>Buy</button><label>Name</label> b<select><option>x<option>y</select>") == ["a b"]
    assert texts("1 < 2 <3 </ x> y<!> <!--> z <!-- w --> end<br/>ing</br>s") == ["1 < 2 <3 y z end ing s"]
    assert texts("<head><title>a <b> t</title><p>body without a tag</p>") == ["body without a tag"]
    assert texts("<svg><g/><title>no</title></svg>x <math><mi>y</mi><mo>=</mo><mn>2</mn></math>") == ["x y=2"]
    assert texts("<p>a<svg><path d='x'><text>no</text><p>b</p><svg><foreignObject><div>no</div></foreignObject></svg>c") == ["a", "b", "c"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e<dt>f</dl>") == ["a", "b", "c", "d", "e", "f"]


def test_long_and_deep_pages_take_time_in_proportion():
    shapes = [
        "<a " * 2_000_000, "<div>x" * 100_000, "<foo>" * 50_000 + "<h1>x</h1>" * 50_000, "<i><div>" + "<b>" * 50_000 + "</i>x" * 50_000, "</x>" * 200_000,
        '<p title="' * 200_000, "<!--" * 1_000_000, "<script>" * 200_000, "<p>" + "word " * 2_000_000,
    ]
    begin = time.time()
    for page in shapes:
        blocks(page)
    main_text(shapes[1], default_field())
    assert time.time() - begin < 90
    assert len(blocks("<div>x" * 100_000)) == 100_000


PAGES = [
    ('<html><body><div id="top"><a href="/">Home</a> | <a href="/a">About us</a> | <a href="/c">Contact</a></div><div id="content"><h1>How rivers bend</h1><p>A river seldom runs straight for long, and the reasons are simple.</p>'
     '<p>Water on the outside of a bend moves faster. It carries soil away, and the bend grows.</p><h2>Oxbow lakes</h2><p>In the end the river cuts through the neck.</p></div><div id="footer">Copyright 2020. All rights reserved.</div></body></html>',
     "How rivers bend\nA river seldom runs straight for long, and the reasons are simple.\nWater on the outside of a bend moves faster. It carries soil away, and the bend grows.\nOxbow lakes\nIn the end the river cuts through the neck."),
    ('<body><header class="site-header"><ul class="menu"><li><a href="/n">News</a><li><a href="/s">Sport</a></ul></header><main><article class="post"><h1>Bread without kneading</h1><p>Mix flour, water and salt, and <em>wait</em>.'
     '<ul><li>400 g of flour<li>300 g of water</ul><div class="advert">Buy our pans now!</div><p>Bake it for forty minutes in a closed pot.</article></main><section class="comments"><h3>3 comments</h3><p>Worked for me, thanks a lot.</p></section><footer><p>Impressum</p></footer>',
     "Bread without kneading\nMix flour, water and salt, and wait.\n400 g of flour\n300 g of water\nBake it for forty minutes in a closed pot."),
    ('<div class="cookie-banner">We use cookies. <button>Accept</button></div><nav class="breadcrumb"><a href="/">Start</a> &gt; <a href="/x">Guides</a></nav><article><h1>Tying a bowline</h1><p>Make a small loop &amp; pass the end through it.</p>'
     '<blockquote>The rabbit comes out of the hole.</blockquote><p>Pull it tight.</p></article><aside class="sidebar"><h2>Related</h2><ul><li><a href="/r">Reef knot</a></ul></aside><form class="newsletter"><label>Email</label><input><p>Sign up for our letter</p></form>',
     "Tying a bowline\nMake a small loop & pass the end through it.\nThe rabbit comes out of the hole.\nPull it tight."),
]


def test_hand_labelled_pages():
    for page, want in PAGES:
        assert main_text(page, default_field()) == want


class Plain(HTMLParser):
    """Texts of the leaf blocks inside article, for pages whose block-level tags are closed."""

    LEAVES = {"p", "h1", "h2", "h3", "li", "div", "article", "ul", "section", "blockquote"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out, self.run = 0, [], []

    def break_(self):
        text = " ".join("".join(self.run).split())
        if self.depth and text:
            self.out.append(text)
        self.run = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.run.append(" ")
        if tag in self.LEAVES:
            self.break_()
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag in self.LEAVES:
            self.break_()
        self.depth -= tag == "article"

    def handle_data(self, data):
        self.run.append(data)


def test_query_matches_an_independent_reader(spark):
    """The main text of every page of the table stands in its article element, which the operator doesn't know."""
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op8_html_extract(spark, SF).collect()
    assert len(rows) == len(html)
    for r in rows:
        plain = Plain()
        plain.feed(html[r.page_id] or "")
        plain.close()
        assert r.text == "\n".join(plain.out) and r.n_chars == len(r.text)


RIVER = ["How rivers bend", "A river seldom runs straight for long, and the reasons are simple.", "Water on the outside of a bend moves faster. It carries soil away, and the bend grows.", "In the end the river cuts through the neck and leaves a lake behind."]
H, P1, P2, P3 = RIVER
BODY = f"<h1>{H}</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>"
MENU = '<ul class="menu"><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather</a></li></ul>'
FOOT = '<div class="footer"><p>Copyright 2020 River Post</p></div>'
#: Hand-labelled pages by shape: the page and the lines of its article.
SHAPES = {
    "body names a sidebar": (f'<body class="home has-sidebar sticky-header">{MENU}{BODY}{FOOT}</body>', RIVER),
    "wrapper names a sidebar": (f'<body><div class="layout-with-sidebar share-enabled">{MENU}<div class="content">{BODY}</div></div>{FOOT}</body>', RIVER),
    "wrapper is called as a region": (f'<body><div class="sidebar"><div class="header">{MENU}</div>{BODY}</div>{FOOT}</body>', RIVER),
    "server form around the page": (f'<body><form id="aspnetForm" method="post"><div id="header">{MENU}</div><div id="main">{BODY}</div>{FOOT}</form></body>', RIVER),
    "plain divs": (f'<body><div>{MENU}</div><div><div>{H}</div><div>{P1}</div><div>{P2}</div><div>{P3}</div></div>{FOOT}</body>', RIVER),
    "paragraphs by line breaks alone": (f'<body>{MENU}<div id="content"><h1>{H}</h1>{P1}<br><br>{P2}<br>{P3}</div>{FOOT}</body>', [H, f"{P1} {P2} {P3}"]),
    "table layout": (f'<body><table><tr><td class="navbar"><a href="/">Home</a> <a href="/x">Maps</a> <a href="/y">Books</a></td></tr><tr><td>{BODY}</td></tr><tr><td class="footer">Copyright 2020</td></tr></table></body>', RIVER),
    "no classes at all": (f'<body><nav><a href="/">Home</a> <a href="/m">Maps</a></nav>{BODY}<footer>Copyright 2020 River Post</footer></body>', RIVER),
    "list with links": (
        f'<body>{MENU}<article><h1>{H}</h1><p>{P1}</p><ul><li><a href="/a">Read more books</a></li><li>Walk along a river</li><li><a href="/b">Look at old maps</a></li></ul><p>{P3}</p></article>{FOOT}</body>',
        [H, P1, "Read more books", "Walk along a river", "Look at old maps", P3],
    ),
    "heading of a discussion": (
        f'<body><article>{BODY}</article><section class="comments"><h3>What readers say</h3><div class="comment"><p>I saw such a lake last year, it was lovely.</p></div><div class="comment"><p>Thank you for the clear words.</p></div></section></body>', RIVER),
    "more discussion than article": (
        f'<body><article><h1>{H}</h1><p>{P1}</p></article><div id="comments"><h2>Discussion</h2>' + "".join(f"<div><p>I have seen number {k} of them, and it was a very fine lake with many birds and some boats on it.</p></div>" for k in range(12)) + "</div></body>", [H, P1]),
    "advert and newsletter inside": (f'<body><main><h1>{H}</h1><p>{P1}</p><div class="advert">Boots for every river, now cheaper!</div><p>{P2}</p><form class="newsletter"><p>Get our letter</p><input></form><p>{P3}</p></main></body>', RIVER),
    "side column": (f'<body><div class="row"><div class="col-8 content">{BODY}</div><div class="col-4 sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten bridges</a></li><li><a href="/2">Old mills</a></li></ul></div></div>{FOOT}</body>', RIVER),
    "cookie notice first": (f'<body><div id="cookie-banner"><p>We use cookies to make this site better.</p><button>OK</button></div><article>{BODY}</article>{FOOT}</body>', RIVER),
    "unclosed label before the article": (f"<body><label>Search <input>{BODY}</body>", RIVER),
    "unclosed paragraphs": (f"<body><article><h1>{H}</h1><p>{P1}<p>{P2}<p>{P3}</article><footer>Copyright 2020</body>", RIVER),
    "comment that ends with a bang": (f"<body><article><h1>{H}</h1><p>{P1}</p><!-- x --!><p>{P2}</p></article></body>", [H, P1, P2]),
    "quote and preformatted text": (f"<body><article><h1>{H}</h1><p>{P1}</p><blockquote>{P2}</blockquote><pre>one\n two</pre></article></body>", [H, P1, P2, "one two"]),
    "header inside the article": (f'<body><header class="site-header">{MENU}</header><article><header><h1>{H}</h1></header><p>{P1}</p><p>{P2}</p></article>{FOOT}</body>', [H, P1, P2]),
    "breadcrumbs and share bar": (f'<body><nav class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/r">Rivers</a></nav><article>{BODY}<div class="share"><a href="#">Share</a> <a href="#">Tweet</a></div></article>{FOOT}</body>', RIVER),
    "deep wrappers": ("<body>" + "".join(f'<div class="w{k} page-header-layout">' for k in range(8)) + BODY + "</div>" * 8 + FOOT + "</body>", RIVER),
    "table of figures": (f"<body><main><h1>{H}</h1><p>{P1}</p><table><tr><th>River</th><th>Length</th></tr><tr><td>Elbe</td><td>1094 km</td></tr></table><p>{P2}</p></main></body>", [H, P1, "River", "Length", "Elbe", "1094 km", P2]),
}


def test_hand_labelled_shapes():
    got = {name: main_text(page, default_field()).split("\n") for name, (page, _) in SHAPES.items()}
    assert got == {name: lines for name, (_, lines) in SHAPES.items()}


def test_hidden_elements_end_where_blocks_begin():
    for name in ("label", "button", "select", "object", "video", "canvas", "audio", "noscript"):
        assert texts(f"<body><{name}>x<p>First</p><p>Second</p></body>") == ["First", "Second"], name
        assert texts(f"<{name}>x<div>no</div></{name}><p>First</p>") == ["First"], name
        assert texts(f"<{name}>x<p>First</p><{name}>no</{name}><p>Second") == ["First", "Second"], name
    assert texts("<p>a</p><!-- x --!><p>b</p><!-- y -- ! --><p>c</p>") == ["a", "b", "c"]
    begin = time.time()
    for page in ("<label><p>" * 100_000, "<button>" * 50_000 + "<div>" * 50_000 + "</button>" * 50_000, "<!-- --!" * 300_000):
        blocks(page)
    assert time.time() - begin < 60
