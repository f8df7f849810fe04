import numpy as np

from sievecraft.llm import url_filter
from sievecraft.llm.html_blocks import blocks
from sievecraft.llm.html_extract import default_field, extract, labelled_pages, main_text, marginals, measured
from sievecraft.llm.url_filter import RULES, judge


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else (0, None, "allow")
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/1", "https://www.example.com/en/", "https://x.www.example.com/en/a?b#c", "http://example.com/english", "http://a.net/es/1",
    "http://net/fr/", "ftp://u:p@b.net:80/fr/", "http://xexample.com/en/", "http://b.net/de/", "http://com", "http://com/", "https://é.com/?q=/en/", "a://b://c.com/x", "http://q.org#/en/", "http://example.com/en/" + "x" * 9000,
]


def test_urls_match_brute_force(spark, monkeypatch):
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(URLS * 2)], "page_id long, url string, host string").repartition(3)
    many = [(f"h{k}.com", "/", "block") for k in range(40)] + [("h1.com", "/a", "allow"), ("h1.com", "", "block")]
    extra = spark.createDataFrame([(k, f"http://s.h{k}.com/abc", "") for k in range(60)], pages.schema)
    for rules, keys in ((list(RULES), 1000), (list(RULES) + many, 7), ([], 5)):
        monkeypatch.setattr(url_filter, "MAX_KEYS", keys)
        got = judge(pages.unionByName(extra), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
        urls = URLS * 2 + [f"http://s.h{k}.com/abc" for k in range(60)]
        assert len(got) == len(urls)
        want = sorted((k, *plain_verdict(u, rules)) for k, u in [*enumerate(URLS * 2), *((k, f"http://s.h{k}.com/abc") for k in range(60))])
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert judge(pages.limit(0), spark.createDataFrame(list(RULES), "host string, path string, verdict string")).count() == 0


def test_blocks():
    page = '<head><title>T</title></head><body class="x">a <b>bold<br>c</b><p>one<p>two &amp;amp; &lt;b&gt;</div><script>var t="</p>";</script><!-- <p>no</p> -->three<ul><li>l1<li>l2</ul>end<par'
    assert [b.text for b in blocks(page)] == ["a bold c", "one", "two &amp; <b>", "three", "l1", "l2", "end"]
    assert blocks("") == [] and [b.text for b in blocks("plain\n\n text")] == ["plain text"]
    assert blocks('<div class="ad top"><a href="x>y">link</a></div>')[0].path == ("div ad top",)


def test_field_finds_the_main_text_of_unseen_pages():
    field = default_field()
    right = total = 0
    for page, labels in labelled_pages(150, seed=77):
        found = field.decode(*measured(page))
        assert len(found) == len(labels)
        right += sum(a == b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total > 0.985
    page = '<body><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div><article><h1>Title</h1><p>First &quot;one&quot;.</p><aside class="promo">Ad</aside><p>Second.</article><section id="comments"><p>Nice text indeed.</p></section><footer>&copy; me</footer>'
    assert main_text(page, field) == 'Title\nFirst "one".\nSecond.'


def test_viterbi_and_marginals_match_enumeration():
    field = default_field()
    found, total = measured(labelled_pages(3, seed=5)[1][0])
    page = found[:9]
    e, t = np.array(field.emissions(page, total)), np.array(field.transitions)
    n = len(e)
    scores = []
    for m in range(1 << n):
        y = [m >> k & 1 for k in range(n)]
        scores.append((sum(e[k] for k in range(n) if y[k]) + sum(t[a][b] for a, b in zip(y, y[1:], strict=False)), y))
    assert max(scores)[1] == field.decode(page, total)
    z = np.logaddexp.reduce([s for s, _ in scores])
    want = sum(np.exp(s - z) * np.array(y) for s, y in scores)
    assert np.allclose(marginals(e, t)[0], want)


def test_extract(spark):
    rows = [(1, "u", "<article><p>x y</p></article>", 1), (2, None, None, None), (2, None, None, None), (None, "u", "", 1), (4, "u", "<p>" + "long text. " * 30000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert got[1].text == "x y" and got[1].n_chars == 3 and got[2].text == "" and got[None].n_chars == 0 and got[4].n_chars == len("long text. " * 30000) - 1
    assert extract(pages).count() == 5 and extract(pages.limit(0)).count() == 0
