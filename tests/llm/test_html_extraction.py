import math
import random
import time
from statistics import mean

from cytolith.llm import op9_html_extraction as op
from cytolith.llm.common import table

PAGE = "page_id long, url string, html string, host string, removed string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine") for r in rows], PAGE)


def texts(spark, rows):
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in op.main_text(make(spark, rows)).collect()}


def test_blocks_references_and_noise():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><header>Top</header>
    <div class="cookie-notice">Cookies</div><article><h1>A &amp; B</h1><p>one\n  two<br>three <b>bold</b>&nbsp;x</p><p>next<p>last &lt;tag&gt; &#233;
    <script>var a = "<p>no</p>";</script><form>field</form><div class="comments"><p>reader</p></div></article><aside>side</aside><footer>&copy;</footer></body></html>"""
    assert op.extract(page) == "A & B\none two three bold x\nnext\nlast <tag> é"


def test_malformed_pages():
    assert op.extract(None) == op.extract("") == op.extract("<p></p>") == ""
    assert op.extract("plain < text & more") == "plain < text & more"
    assert op.extract("<p>a<!-- b --><p>c<!-- open") == "a\nc"
    assert op.extract("<nav>menu<article><p>text</article>") == "text"
    assert op.extract("<article><p><b>one<br><p>two") == "one\ntwo"
    assert op.extract('<p title="a > b">x</p></div></span>y') == "x\ny"
    assert op.extract("<script>x") == "" and op.extract("<div><ul><li>a<li>b</ul></div>") == "a\nb"
    assert len(op.extract("<div>" * 3000 + "deep")) == 4


def template_site(n, host="h.example"):
    return [(k, f"http://{host}/{k}", f"<div class=top>Best site ever</div><div class=body><p>story number {k} tells of {k * 7}</p></div><div class=end>All of it is ours</div>") for k in range(n)]


def test_repeated_branches_of_a_site_go(spark):
    got = texts(spark, template_site(8))
    assert got[3] == ("story number 3 tells of 21", 26)


def test_little_is_known_of_small_sites(spark):
    assert texts(spark, template_site(2))[0][0] == "Best site ever\nstory number 0 tells of 0\nAll of it is ours"
    assert texts(spark, template_site(3))[0][0] == "story number 0 tells of 0"


def varied_site():
    """Pages of two hosts whose layout, menu and texts vary."""
    rng = random.Random(3)
    rows = []
    for k in range(40):
        paragraphs = "".join(f"<p>{rng.choice(['shared line', f'text {k} {j}'])}</p>" + ("<div class=box><ul><li>item</ul></div>" if rng.random() < 0.3 else "") for j in range(rng.randint(1, 4)))
        menu = "".join(f"<li>{w}" for w in rng.sample(["home", "about", "news"], 3 if k % 4 else 2))
        rows.append((k, f"http://{'ab'[k % 2]}.example/{k}", f"<div class=top>Site</div><div class=list><ul>{menu}</ul></div><div class=body>{paragraphs}</div>"))
    return rows


def recount(rows):
    """Importance by host and text node, counted page by page with plain formulas."""
    pages = {}
    for _, url, page in rows:
        host = url.split("/")[2]
        mine = op.Page(page).rows()
        pages.setdefault(host, {}).setdefault(next(x[3] for x in mine if x[0] <= op.ARTICLE_TEXT), set()).update(mine)
    out = {}
    for host, of_host in pages.items():
        content, style, around = {}, {}, {}
        held = {}
        for page, mine in of_host.items():
            for kind, node, value, x in mine:
                if kind == op.AROUND:
                    around.setdefault(node, {})[value] = x
                else:
                    held.setdefault((kind, node), {}).setdefault(value, set()).add(page)
        size = {key: len(set().union(*values.values())) for key, values in held.items()}
        for (kind, node), values in held.items():
            m = size[kind, node]
            if kind <= op.ARTICLE_TEXT:
                content[node] = 1.0 if m == 1 else 1 - sum(math.log(len(p)) / math.log(m) for p in values.values()) / len(values)
            elif kind == op.LAYOUT:
                m = sum(map(len, values.values()))  # copies in another layout count
                style[node] = 1.0 if m == 1 else -sum(len(p) / m * math.log(len(p) / m) for p in values.values()) / math.log(m)
        combined = {s: (style[s] + mean([content[t] for t in content if s in around[t]])) / 2 for s in {s for near in around.values() for s in near}}
        for node, c in content.items():
            weights = {s: 0.5**k for s, k in around[node].items()}
            branch = sum(w * combined[s] for s, w in weights.items()) / sum(weights.values())
            m = size[next(kind for kind in (0, 1) if (kind, node) in size), node]
            out[host, node] = (m * c * (1 + branch) / 2 + 1) / (m + 1)
    return out


def test_importance_equals_a_plain_recount(spark):
    rows = varied_site()
    got = {(r["host"], r["node"]): r["importance"] for r in op.style_nodes(make(spark, rows)).collect()}
    wanted = recount(rows)
    assert got.keys() == wanted.keys() and all(math.isclose(got[k], wanted[k], abs_tol=1e-9) for k in got)
    body, top = op.path_of("div.body", "p"), op.path_of("div.top")
    assert got["a.example", body] > 0.5 and got["a.example", top] < 0.1 and got["a.example", op.path_of("div.list", "ul", "li")] < op.LOW


def test_salted_join_gives_the_same(spark):
    rows = varied_site()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(op.main_text(make(spark, rows), salted=True)) == key(op.main_text(make(spark, rows), salted=False))


def test_a_varied_layout_keeps_what_a_fixed_one_loses(spark):
    """Texts of which most recur: important in a branch that each page lays out in its own way."""
    fixed = [(k, f"http://f.example/{k}", f"<div class=x><p>{'abc'[k % 3]}</p></div><div class=z><p>text {k}</p></div>") for k in range(9)]
    varied = [(k, f"http://v.example/{k}", f"<div class=x>{'<i class=q></i>' * k}<p>{'abc'[k % 3]}</p></div><div class=z><p>text {k}</p></div>") for k in range(9)]
    node = op.path_of("div.x", "p")
    value = lambda rows: next(r for r in op.style_nodes(make(spark, rows)).collect() if r["node"] == node)
    a, b = value(fixed), value(varied)
    assert math.isclose(a["content"], b["content"]) and a["importance"] < b["importance"]


def test_names_do_not_decide_alone():
    assert op.extract('<div class="content with-sidebar"><p>a b</p></div>') == "a b"
    assert op.extract('<main class="has-sidebar"><p>a b</p></main>') == op.extract('<article class="post share-enabled"><p>a b</p></article>') == "a b"
    assert op.extract('<div class="page header-fixed"><p>a b</p></div>') == op.extract('<body class="no-sidebar"><div id="overlay"><p>a b</p></div></body>') == "a b"
    assert op.extract('<div class="no-sidebar"><div class="sidebar">links</div><p>a longer text</p></div>') == "a longer text"
    assert op.extract('<article class="comments-open"><p>text</p><section class="comments"><article class="comment">reader</article></section></article>') == "text"
    assert op.extract('<p>one <span class="ad">two</span> three is long</p>') == "one three is long"


def test_the_narrower_of_main_and_article():
    assert op.extract("<main><div>crumbs</div><article>the article text</article><p>next: x</p></main>") == "the article text"
    assert op.extract("<main><p>the text of the page</p><article>teaser</article></main>") == "the text of the page\nteaser"


def test_very_long_page():
    page = "<div class=a>" + "<p>a < b &amp; c</p></i><!-- x -->" * 300_000 + "<b>" * 50_000
    began = time.process_time()
    assert op.extract(page).count("\n") == 299_999 and time.process_time() - began < 60


def test_copies_do_not_become_template(spark):
    rows = [(k, "http://c.example/a", "<article><h1>Same</h1><p>The same story for all</p></article>") for k in range(50)]
    rows += [(100 + k, f"http://c.example/{k}", f"<article><h1>Title {k}</h1><p>story {k}</p><p>a passage that many share</p></article>") for k in range(30)]
    got = texts(spark, rows)
    assert got[0][0] == "Same\nThe same story for all" and got[105][0] == "Title 5\nstory 5\na passage that many share"


def test_null_repeated_and_empty(spark):
    rows = op.main_text(make(spark, [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "no url", None), (2, "http://x/", "<p>b</p>")])).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in rows) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "b", 1)]
    assert op.main_text(make(spark, [])).count() == 0


def test_articles_of_the_small_tables(spark, sf_dir):
    import html
    import re

    pages = table(spark, sf_dir, "pages")
    got = {r["page_id"]: r["text"] for r in op.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", "", inner))
        wanted = [re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts]
        assert got[r["page_id"]] == "\n".join(filter(None, wanted))
