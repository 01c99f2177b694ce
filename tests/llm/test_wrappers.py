import html
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tactus.llm import wrappers


def page(nav, ad, blocks, title="t", body="article"):
    items = "".join(f'<li><a href="/{n}">{n}</a></li>' for n in nav)
    text = "".join(f"<p>{b}</p>" for b in blocks)
    return f"<html><head><title>{title}</title></head><body><nav><ul>{items}</ul></nav>{ad}<{body}><h1>{title}</h1>{text}</{body}><footer>foot</footer></body></html>"


def infer(pages):
    done = wrappers.skeleton(pages[0])
    for p in pages[1:]:
        done = wrappers.merged(done, wrappers.skeleton(p))
    return done


def test_mismatches_become_slots_groups_and_options():
    w = infer([page("ab", "", ["x", "y"]), page("abcd", '<div class="ad">buy</div>', ["z"]), page("a", "", [])])
    text = wrappers.pattern(w)
    assert "(<li>#</>)+" in text and "(<div.ad>#</>)?" in text and "(<p>#</>)*" in text and "(<h1>#</>)<" not in text
    assert "|" not in text
    assert wrappers.pattern(infer([page("ab", "", ["x"])] * 3)) == wrappers.pattern(infer([page("ab", "", ["x"])]))


def test_extracts_the_article_alone():
    ad = '<div class="ad">buy</div>'
    p = page("abc", ad, ["One &amp; two\n  three", "Four<br>five <b>six</b>", '<a href="x">link</a> stays'])
    assert wrappers.extract(p, wrappers.region(infer([p]))) == "t\nOne & two three\nFour five six\nlink stays"


def test_broken_markup():
    p = '<body><nav><ul><li>a<li>b</ul></nav><article><h1>T</h1><p><b>One<br><p>Two</p><div class="comments"><p>no</p></div><p>Three<script>x="</p>"</script><form>mail</form></article><footer>&copy; f'
    assert wrappers.extract(p, wrappers.region(infer([p]))) == "T\nOne\nTwo\nThree"
    assert wrappers.extract("no markup at all &lt;", {"path": [], "drop": []}) == "no markup at all <"
    assert wrappers.extract("", {"tag": "article"}) == "" and wrappers.extract("<", {"path": [], "drop": []}) == "<"


def test_pages_without_article_use_the_weight_of_text():
    def made(n):
        menu = '<div class="top"><p><a href="1">home</a> <a href="2">more links here</a></p></div>'
        return f'<body>{menu}<div class="content"><p>{"word " * (50 + n)}</p><p>second</p></div><div class="sidebar"><p>side</p></div></body>'

    w = infer([made(k) for k in range(4)])
    text = wrappers.extract(made(1), wrappers.region(w))
    assert text == "word " * 50 + "word\nsecond"


def test_odd_rows(spark):
    long = page("ab", "", ["word " * 100_000])
    rows = [(1, "http://a.com/1", None, "x"), (2, None, "", "x"), (3, "nonsense", page("a", "", ["p"]), "x"), (4, "http://A.com:80/2", long, "x"), (4, "http://a.com/2", long, "x")]
    rows += [(10 + k, "https://hot.org/", page("abc"[: k % 3 + 1], "", [f"text {k}"] * (k % 4)), "x") for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(4)
    out = {r["page_id"]: r["text"] for r in wrappers.main_text(df).collect()}
    assert wrappers.main_text(df).count() == len(rows)
    assert out[1] == out[2] == "" and out[3] == "t\np" and out[4] == "t\n" + " ".join(["word"] * 100_000)
    assert all(out[10 + k] == "\n".join(["t", *[f"text {k}"] * (k % 4)]) for k in range(40))
    assert wrappers.main_text(df.limit(0)).collect() == []
    hosts = {r["host"] for r in wrappers.wrappers(df).collect()}
    assert hosts == {"a.com", "", "hot.org"}


def test_salted_join_gives_the_same(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = sorted(map(tuple, wrappers.main_text(df).collect()))
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, wrappers.main_text(df).collect())) == want


def test_query(spark):
    """Against what a plain cut of the pages' known template gives."""
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    out = entry.queries()["op4_html_extraction"](spark, d).collect()
    assert len(out) == len(pages)
    for r in out:
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_hosts_with_more_than_one_template(spark):
    """Old pages of a host, and all pages without one, keep their text whatever template the others have."""
    body = "word " * 60 + "end"
    kinds = [
        page("ab", "", [body], body="article"),
        page("ab", "", [body], body="main"),
        f'<body><div class="top"><a href="1">home</a></div><div class="content"><h1>t</h1><p>{body}</p></div></body>',
        f'<body><div class="old"><table><tr><td><h1>t</h1><p>{body}</p></td></tr></table></div></body>',
        f"t<p>{body}",
    ]
    for url in ("http://mixed.org/", None):
        for common in range(len(kinds)):
            many = [(k, url, kinds[k]) for k in range(len(kinds))] + [(common, url, kinds[common])] * 20
            df = spark.createDataFrame(many, "page_id long, url string, html string").repartition(3)
            if common in (0, 3):
                assert {(r["page_id"], r["text"]) for r in wrappers.main_text(df).collect()} == {(k, f"t\n{body}") for k in range(len(kinds))}
            where = wrappers.region(infer([h for _, _, h in many]))
            assert [wrappers.extract(h, where) for h in kinds] == [f"t\n{body}"] * len(kinds)


def test_template_text_in_the_article_is_left_out():
    def made(k, note="Subscribe to our letter"):
        return f'<body><article><h1>Same head</h1><p>Text {k} {"w" * k}</p><div class="x">{note}</div><p>More {k} of it, longer by far</p></article></body>'

    pages = [made(k) for k in range(12)]
    w = infer(pages)
    assert "(<div.x>=" in wrappers.pattern(w) and "(<p>#</>)" in wrappers.pattern(w)
    where = wrappers.region(w)
    assert all("Subscribe" not in wrappers.extract(p, where) for p in pages)
    assert wrappers.extract(pages[3], where) == "Same head\nText 3 www\nMore 3 of it, longer by far"
    assert "Another" in wrappers.extract(made(3, "Another note"), where)
    assert "Subscribe" in wrappers.extract(pages[3], wrappers.region(infer(pages[:4])))  # too few agree
    again = [made(3)] * 40  # copies of one page show nothing
    assert "Subscribe" in wrappers.extract(again[0], wrappers.region(infer(again)))


def test_raw_elements_and_class_words_cut_no_text():
    def text(inner, body="<body>", article="<article>"):
        p = f"<html><head><title>x</title></head>{body}{article}{inner}</article></body></html>"
        return wrappers.extract(p, wrappers.region(infer([p])))

    assert text('<p>One</p><svg class="i"/><p>Two</p>') == "One\nTwo"
    assert text('<p>One <svg class="i"/>more</p><p>Two</p><svg><path d=""/></svg><p>Three</p>') == "One more\nTwo\nThree"
    assert text("<p>One</p><svg><path><p>Two</p><svg></svg><p>Three</p>") == "One\nTwo\nThree"
    assert text("<p>One</p><title/><p>Two</p><noscript><p>Three</p>") == "One\nTwo\nThree"
    assert text("<p>One</p><script src=x/y/>var a</script><p>Two</p>") == "One\nTwo"
    assert text("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be<math/> so</p>") == "Let x=2 be so"
    assert text("<p>One</p>", '<body class="has-sidebar">') == text("<p>One</p>", "<body class='sidebar'>") == "One"
    assert text("<p>One</p>", '<body><div class="content no-comments" id="ad-free">') == "One"
    assert text("<p>One</p>", article='<article class="post share-enabled">') == text("<p>One</p>", article='<article class="related">') == "One"
    assert text('<p>One</p><div class="ad-slot">no</div><div class="post-comments">no</div><div role="complementary">no</div>') == "One"


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=30), st.lists(st.sampled_from("abcdefgh"), max_size=30))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = wrappers.aligned(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(pairs) == longest(a, b)
    whole = wrappers.TABLE
    try:
        wrappers.TABLE = 0  # anchors and next places alone
        pairs = wrappers.aligned(a, b)
    finally:
        wrappers.TABLE = whole
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_large_pages_take_little_time():
    began = time.perf_counter()
    wide = lambda n, k: "<body><article>" + "".join(f'<p class="c{j % 7}{"abc"[j % k]}">t{j}</p><h2>s</h2>' for j in range(n)) + "</article></body>"
    w = infer([wide(4000, 3), wide(6000, 2), wide(20_000, 1)])
    assert wrappers.extract(wide(50, 1), wrappers.region(w)).startswith("t0\ns\nt1")
    deep = "<div>" * 100_000 + "<p>text</p>"
    assert wrappers.extract(deep, wrappers.region(infer([deep, "<p>x</p>"]))) == "text"
    assert time.perf_counter() - began < 15


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", page("a", "", ["p"]), 5, "w", 6)], "page_id long, url string, html string, host int, _where string, salt int")
    out = wrappers.main_text(df)
    assert out.columns == [*df.columns, "text"] and [tuple(r)[3:] for r in out.collect()] == [(5, "w", 6, "t\np")]


LEAKS = "post-comments-wrapper commentlist replies reader-responses site-footer-inner main-menu-container top-ads-box article-sidebar-left".split()


def test_inner_boilerplate_by_class_words():
    """Inside the article, on a host without article elements too; a layout's name bars nothing that holds the text."""
    for tag in ("article", "div"):
        for name in LEAKS:
            def made(k, name=name, tag=tag):
                return f'<body><nav><a href="/">home</a></nav><{tag} class="story"><h1>Head {k}</h1><p>{f"text {k} " * 30}</p><div class="{name}"><p>{f"said {k} " * 5}</p><p>more of it {k}</p></div><p>last {k}</p></{tag}></body>'

            pages = [made(k) for k in range(12)]
            where = wrappers.region(infer(pages))
            assert [wrappers.extract(p, where) for p in pages] == ["\n".join([f"Head {k}", f"text {k} " * 29 + f"text {k}", f"last {k}"]) for k in range(12)], (tag, name)
            whole = [p.replace("<body>", f'<body><div class="{name}">').replace("</body>", "</div></body>").replace(f'<div class="{name}"><p>', '<div class="plain"><p>') for p in pages]
            assert f"said 3 said 3" in wrappers.extract(whole[3], wrappers.region(infer(whole)))  # noqa: F541


def test_the_wrapper_decides(spark):
    """On the test pages, with article elements renamed, the text is the same; without a wrapper it is another."""
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    texts = lambda rows: {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = texts(rows)
    renamed = [(i, u, re.sub(r"<(/?)article", r"<\1div", h)) for i, u, h in rows]
    assert texts(renamed) == want
    assert not any(wrappers.extract(h, {}) == want[i] for i, _, h in rows if want[i])


def test_grid_columns_are_kept_apart():
    """Columns of a grid are no list, counted items are one."""
    for main, side in (("col-md-8", "col-md-4"), ("span8", "span4"), ("story", "extra")):
        def made(k, main=main, side=side):
            return f'<body><div class="row"><div class="{main}"><p>{f"text {k} " * 40}</p><p>end {k}</p></div><div class="{side}"><p>The same on every page</p><p>Follow us</p></div></div></body>'

        pages = [made(k) for k in range(12)]
        where = wrappers.region(infer(pages))
        assert all(wrappers.extract(p, where) == f"text {k} " * 39 + f"text {k}\nend {k}" for k, p in enumerate(pages)), main
    items = infer(["<ul>" + "".join(f'<li class="item-{j}">x{j}</li>' for j in range(1, n)) + "</ul>" for n in (2, 3, 9)])
    assert wrappers.pattern(items) == "(<ul>(<li.item-0>#</>)+</>)"


def test_navigation_is_known_at_any_depth():
    deep = "<div>" * 150
    p = f"<body><article>{deep}<nav><p>menu</p></nav><p>{'text ' * 20}</p>{'</div>' * 150}<p>end</p></article></body>"
    assert wrappers.extract(p, wrappers.region(infer([p, p]))) == "text " * 19 + "text\nend"
