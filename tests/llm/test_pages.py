import html as html_lib
import random
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from faultline.llm import html_text, urls

SCHEMA = "page_id long, url string, html string, host string, text string, reference int"


def page(seed, body=None, extra=""):
    r = random.Random(seed)
    p = "".join(f"<p>para {seed} {i} {r.random()} &amp; caf&eacute;\n more<br>x" for i in range(3))
    return (f"<!DOCTYPE html><html><head><title>T {seed}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
            f"<nav><ul><li><a href=/x>Home</a></ul></nav><div class='side'><p>Welcome to our site</p></div>{extra}"
            f"<div id=c><h1>Head {seed}</h1>{body or p}</div><div class='box'><p>Slogan {seed % 2}</p></div><form><p>Your mail</p></form><footer>foot {seed}</footer>")


def test_simple_tree_matching():
    a = html_text.Page("<div><p>a</p><ul><li>x</li></ul></div><section><p>b</p></section>").skeleton()
    b = html_text.Page("<div><h1>t</h1><ul><li>y</li></ul></div><aside>z</aside><section><p>q</p></section>").skeleton()
    names = lambda s: [x.split("\t")[1] for x in s.split("\n")]
    got = {names(a)[i]: names(b)[j] for i, j in enumerate(html_text.aligned(a, b)) if j >= 0}
    assert got == {"": "", "div": "div", "ul": "ul", "li": "li", "section": "section", "p": "p"}
    assert html_text.aligned(a, a) == tuple(range(len(names(a))))


def test_constant_and_rotating_nodes_are_template(spark):
    rows = [(i, "http://site.example/p", page(i), "h", "t", 1) for i in range(40)] + [(99, "http://alone.example/", page(99), "h", "t", 1)]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(40):  # no element name tells side, box and c apart: only the values over the pages do
        lines = got[i].text.split("\n")
        assert lines[0] == f"Head {i}" and len(lines) == 4 and all(x.startswith(f"para {i} ") and x.endswith("& café more x") for x in lines[1:])
        assert got[i].n_chars == len(got[i].text)
    assert "Welcome to our site" in got[99].text and "Your mail" not in got[99].text  # one page: elements alone decide


def test_copies_of_a_page_are_no_evidence(spark):
    rows = [(i, f"http://copies.example/p?utm_source={i}", page(1), "h", "t", 1) for i in range(6)]
    rows += [(100 + i, "http://mixed.example/p", page(max(i, 300)), "h", "t", 1) for i in range(320)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(6):
        assert got[i].count("para 1 ") == 3 and "Head 1" in got[i]
    for i in (100, 399, 400, 419):
        assert got[i].split("\n")[0] == f"Head {max(i - 100, 300)}" and got[i].count("para ") == 3


def test_bounded_slots_are_content_on_hosts_of_any_size(spark):
    for n in (30, 300):
        rows = [(i, "http://site.example/p", page(i, extra=f"<div class='by'><p>By author {i % 10}</p></div>"), "h", "t", 1) for i in range(n)]
        for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect():
            assert r.text.split("\n")[0] == f"By author {r.page_id % 10}" and "Welcome" not in r.text and "Slogan" not in r.text


def test_elements_beside_the_article():
    keep = "<article><header><h1>T</h1></header><p>one &lt;b&gt; two</p><p>three</p>{}</article>"
    beside = ["<aside>x</aside>", "<div class='share-links'>x</div>", "<section id=comments><p>x</p></section>", "<div class='cookie-notice'>x</div>",
              "<article class=comment>x</article>", "<noscript>x</noscript>", "<div hidden>x</div>", "<!-- x -->", "<script>if (a<b) x</script>", "<button>x</button>",
              "<div style='display: none'>x</div>", "<div class=ad>x</div>", "<div class=adBanner><p>x</div>"]
    for b in ["", *beside]:
        for t in (keep.format(b), b + keep.format("") + b):
            assert html_text.Page("<html><body class='has-sidebar'><header>Site</header>" + t).content(frozenset()) == "T\none <b> two\nthree", t


def test_broken_markup():
    text = lambda h: html_text.Page(h).content(frozenset())
    assert text("") == "" and text("plain < text") == "plain < text" and text("<p>a<p>b</div><li>c") == "a\nb\nc"
    assert text("<p title='a>b'>x</p><p>y</p attr><table><tr><td>1<td>2<tr><td>3</table>") == "x\ny\n1\n2\n3"
    assert text("a<script>never closed") == "a" and text("<!-- open") == "" and text("<p>&#0;&nbsp;&bogus;") == "� &bogus;".strip()
    assert len(text("<div>" * 3000 + "deep" + "<p>x" * 5000)) == 4 + 2 * 5000


def test_whole_query_is_the_article(spark, sf):
    from faultline.llm.queries import QUERIES

    pages = {r["page_id"]: r for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    got = {r.page_id: r.text for r in QUERIES["op3_html_text"](spark, sf).collect()}
    assert set(got) == set(pages)
    for i, r in pages.items():
        a = re.sub("</?b>", "", re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)).replace("<br>", " ")
        assert got[i] == "\n".join(" ".join(html_lib.unescape(x).split()) for x in re.split("<[^>]*>", a) if x.strip()), i


def test_awkward_pages(spark):
    rows = [(None, None, None, None, None, None), (1, None, "<p>x</p>", "a", "b", 1), (1, None, "<p>x</p>", "a", "b", 1), (2, "http://h.x", "", None, "t", 2)]
    got = html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "x", 1), ("1", "x", 1), ("2", "", 0), ("None", "", 0)]
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0


# --- urls ------------------------------------------------------------------

RULES = [("net/", "block", True), ("example.net/en/", "allow", True), ("example.com/de/", "block", True), ("org/fr/", "allow", True),
         ("bad.example.org/", "block", False), ("x.com/a/b", "block", False), ("net/", "block", True)]


def brute_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
    fit = []
    for k, v, is_rule in RULES:
        h, p = k.split("/", 1)
        if (host == h or host.endswith("." + h)) and (path or ("" if is_rule else "/")).startswith("/" + p):
            fit.append((is_rule, len(k), k, v))
    rules = [f for f in fit if f[0]]
    listed = any(not f[0] for f in fit)
    return (host, path, max(rules)[2], max(rules)[3], listed) if rules else (host, path, None, "block" if listed else "allow", listed)


def test_verdicts_equal_brute_force(spark):
    r = random.Random(4)
    hosts = ["net", "a.net", "example.net", "m.Example.NET", "notexample.net", "example.com", "xexample.com", "w.example.com", "org", "bad.example.org", "q.bad.example.org", "x.com", "y.x.com", "", "é.org", "x.com:80"]
    paths = ["", "/", "/en/", "/en", "/en/1", "/de/2/3", "/fr/", "/fr", "/a/b", "/a/bc", "/a", "//en/"]
    some = [f"{r.choice(['http', 'HTTPS', ''])}://{h}{p}{r.choice(['', '?q=/en/', '#f', '?a#b'])}" for h in hosts for p in paths]
    some += [None, "", "no scheme", "a.net/en/", "http://x://y.net/en/"]
    df = spark.createDataFrame([(i, u, "h", "p", "r", 1) for i, u in enumerate(some)] + [(0, some[0], "h", "p", "r", 1)], "page_id long, url string, host string, path string, rule string, key int")
    entries = spark.createDataFrame(RULES, "key string, verdict string, is_rule boolean")
    got = urls.judge(df, entries).collect()
    assert len(got) == len(some) + 1
    for x in got:
        assert (x.host, x.path, x.rule, x.verdict, x.listed) == brute_verdict(some[x.page_id]), some[x.page_id]
    assert urls.judge(df.limit(0), entries).count() == 0
    assert {x.verdict for x in urls.judge(df, entries.limit(0)).collect()} == {"allow"}


def test_filter_has_no_false_negative(spark):
    entries = spark.range(500).select(F.concat(F.lit("h"), "id", F.lit("/")).alias("key"))
    keys = spark.range(4000).select(F.concat(F.lit("h"), "id", F.lit("/")).alias("key"))
    found = {r.key for r in urls.possible_hits(keys, entries).collect()}
    assert {r.key for r in entries.collect()} <= found and len(found) < 800


def test_hosts_of_very_many_labels(spark):
    """A host gives no more keys than the listed hosts have labels."""
    long = "a." * 100_000
    rows = [(1, f"http://{long}example.com/x"), (2, f"http://{long}b/x"), (3, "http://com/"), (4, "http://" + "c" * 50_000 + ".net")]
    entries = spark.createDataFrame([("example.com/", "block", False), ("com/", "allow", True)], "key string, verdict string, is_rule boolean")
    got = {r.page_id: (r.rule, r.verdict, r.listed) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), entries).collect()}
    assert got == {1: ("com/", "allow", True), 2: (None, "allow", False), 3: ("com/", "allow", False), 4: (None, "allow", False)}
    keys = urls.candidate_keys(spark.createDataFrame([(long + "example.com", "/x")], "host string, path string"), [1], 2)
    assert sorted(r.key for r in keys.collect()) == ["com/", "example.com/"]


# --- the wrapper decides ---------------------------------------------------

def shop_pages(body, n=12):
    """Pages of one host: a varying article within what ``body`` makes of it."""
    return [(i, "http://news.example/x", body(i, f"<p>First story number{i} of word{i * 7}.</p>", f"<p>Second part about thing{i * 13}.</p>")) for i in range(n)]


def texts_of(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def story(i):
    return f"First story number{i} of word{i * 7}.\nSecond part about thing{i * 13}."


def test_constant_notice_inside_an_article_goes(spark):
    got = texts_of(spark, shop_pages(lambda i, a, b: f"<body><article>{a}<p>We use small files to make this site work.</p>{b}</article></body>"))
    assert got == {i: story(i) for i in range(12)}
    few = texts_of(spark, shop_pages(lambda i, a, b: f"<article>{a}<p>Only here.</p>{b}</article>", 3))  # too few pages to tell
    assert few[0].split("\n")[1] == "Only here."


def test_rotating_block_and_menu_without_an_article_go(spark):
    got = texts_of(spark, shop_pages(lambda i, a, b: f'<body class="post postid-{i}"><div class="m{i}">Home News Sport</div><div class="text">{a}{b}</div>'
                                                     f'<div class="box">{["Buy this.", "Buy that."][i % 2]}</div></body>'))
    assert got == {i: story(i) for i in range(12)}


def test_words_of_a_class_do_not_cut_articles(spark):
    got = texts_of(spark, shop_pages(lambda i, a, b: f'<article>{a}<div class="market-share">Share {i} of the market rose.</div>{b}'
                                                     f'<div class="related-work">Work {i} of others.</div></article>'))
    assert got[3] == "First story number3 of word21.\nShare 3 of the market rose.\nSecond part about thing39.\nWork 3 of others."
    links = "".join(f'<p><a href="/{k}">Story {k}</a></p>' for k in range(3))
    got = texts_of(spark, shop_pages(lambda i, a, b: f'<article>{a}{b}<div class="related-posts">{links}</div><div class="share">Send {i}</div></article>'))
    assert got[3] == story(3)


def test_near_copies_keep_their_text(spark):
    """An article that several pages of a small host repeat is no template."""
    same = "".join(f"<p>Paragraph {k} of the same report.</p>" for k in range(6))
    rows = [(i, "http://a.example/", f"<article><p>Edition {i}.</p>{same}</article>") for i in range(8)]
    got = texts_of(spark, rows)
    assert all(got[i] == "\n".join([f"Edition {i}.", *[f"Paragraph {k} of the same report." for k in range(6)]]) for i in range(8))


def test_texts_depend_on_the_template(sf):
    for row in pq.read_table(f"{sf}/pages.parquet").to_pylist()[:40]:
        page = html_text.Page(row["html"] or "")
        to = html_text.aligned(page.skeleton(), page.skeleton())
        assert to == tuple(range(len(to)))
        assert page.content(frozenset(range(len(to)))) == ""


def test_matching_by_tag_prefers_equal_classes():
    read = lambda h: html_text.Page(h).skeleton()
    a, b = read("<div class=x>1</div><div class=y>2</div>"), read("<div class=z>0</div><div class=x>1</div><div class=q>2</div>")
    assert html_text.aligned(a, b) == (0, 2, 3)
    assert html_text.aligned(read("<body class='post id-7'><p>1</p></body>"), read("<body class='post id-81'><p>1</p></body>")) == (0, 1, 2)


def test_deep_pages_are_aligned_in_little_memory():
    import time
    import tracemalloc

    began = time.process_time()
    page = html_text.Page("<div>" * 5000 + "text")
    tracemalloc.start()
    to = html_text.aligned(page.skeleton(), page.skeleton() + "\n1\tp")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert to == tuple(range(5001)) and peak < 100_000_000 and time.process_time() - began < 20
