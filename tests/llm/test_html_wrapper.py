import html as std
import re

import numpy as np
import pytest

from corvane.llm import html_wrapper as h
from corvane.llm import joins


def pages(n=6):
    out = []
    for i in range(n):
        paras = [f"Paragraph {i}.{k} &amp; more  words\n here" for k in range(1 + i % 4)]
        notice = f'<div class="cookie-notice">We use cookies {i}</div>' if i % 2 else ""
        out.append(f"""<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>{notice}<!-- <p>not</p> -->
<article><h1>Title {i}</h1><p><b>Bold {i}<br>{'<p>'.join(paras)}<form><label>Name</label><input></form><aside>See also</aside></article>
<section id="comments"><p>First! {i}</p></section><div class="ad-slot">Buy {i}</div><footer>&copy; 2020</footer></body></html>""")
    return out


def wanted(i):
    return "\n\n".join([f"Title {i}", *[f"Bold {i} Paragraph {i}.0 & more words here"], *[f"Paragraph {i}.{k} & more words here" for k in range(1, 1 + i % 4)]])


def test_articles(spark):
    rows = [(i, f"https://n.example.org/{i}", x, "c", 1) for i, x in enumerate(pages())]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text int")
    got = h.main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    for r in got.collect():
        assert r.text == wanted(r.page_id) and r.n_chars == len(r.text)


def test_hosts_without_articles_are_told_by_slots(spark):
    def page(i):
        links = "".join(f'<a href="/{k}">Link {k} of {i}</a> ' for k in range(5))
        return f"<body><div><ul><li>{links}</li></ul></div><div><p>All rights belong to us.</p><table><tr><td>x{i}</td></tr></table></div><div><h1>Story {i}</h1><p>It begins {i}.</p><p>It ends {i}.</p></div></body>"

    df = spark.createDataFrame([(i, "http://plain.example.com/x", page(i)) for i in range(8)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.main_text(df).collect()}
    assert got[3] == "x3\n\nStory 3\n\nIt begins 3.\n\nIt ends 3."


def test_wrapper_is_union_free_and_aligned():
    a, b = (h.pattern(h.parse(x)) for x in ("<div class=m><p>1</p><p>2</p></div>", "<div class=m><h1>t</h1><p>1</p></div><i>x</i>"))
    assert h.expression(h.align(a, b)) == "<#root><div.m>(<h1>#</>)?(<p>#</>)+</>(#)?</>"
    c = h.pattern(h.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl>"))
    assert h.expression(c) == "<#root><dl>(<dt>#</><dd>#</>)+</></>"


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    odd = [None, "", "<", "no markup & more", "<p>a<p>b", "<article>&lt;b&gt; &nbsp; x</article", "<!-- open", "<script>never closed", "<article><p>" + "w " * 50_000, deep, "<a <b <c", "&#0; &#xD800; &bogus; x"]
    df = spark.createDataFrame([(i if i else None, f"http://odd{i}.example.com/" if i % 3 else None, x) for i, x in enumerate(odd)] * 2, "page_id long, url string, html string")
    got = h.main_text(df).collect()
    assert len(got) == 2 * len(odd) and all(r.text is not None for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[4] == "a\n\nb" and by[8] == ("w " * 50_000).strip() and by[9] == "deep" and by[1] == ""
    assert h.main_text(df.limit(0)).count() == 0


def test_wrappers_folded_in_portions_agree(spark, monkeypatch):
    monkeypatch.setattr(h, "PORTION", 3)
    shapes = [f"<article>{''.join(f'<{t}>x{i}{k}</{t}>' for k, t in enumerate(ts))}</article>" for i, ts in enumerate([("h1", "p"), ("p",), ("h1", "p", "ul"), ("h2", "p"), ("p", "h2"), ("h1", "h2"), ("pre",), ("p", "pre"), ("blockquote", "p"), ("h3",)])]
    df = spark.createDataFrame([(i, "http://h.example.com/", x) for i, x in enumerate(shapes)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.main_text(df).collect()}
    for i, x in enumerate(shapes):
        assert got[i] == "\n\n".join(re.findall(r"x\d+", x))
    assert h.wrappers(df).count() == 1


def test_test_pages(spark):
    """Every page of the small table against its own article, cut out by position."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in h.main_text(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(std.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_places():
    def place(html):
        (path, _, _), = h.texts(h.parse(html))
        return h.place(path)

    assert place("<div class='page has-sidebar'><main><div><p>x") == 1 == place("<article><header><h1>x") == place("<div role=main>x") == place("<div itemprop=articleBody>x")
    for out in ("<section id=comments><article><p>x", "<article class='comment'>x", "<article><div class='share-buttons'>x", "<div class=pageHeader>x", "<div role=banner>x", "<div class='ad-slot'>x", "<main><form>x", "<article><nav>x", "<div id=cookieConsent><p>x"):
        assert place(out) == -1, out
    for either in ("<div><p>x", "<section class=story>x", "<div class='advanced address'>x"):
        assert place(either) == 0, either


def test_copies_of_a_story_are_no_template(spark):
    other = [f"<body><div><p>Story {i}</p></div></body>" for i in range(4)]
    copied = "<body><blockquote><p>The only one of its kind</p></blockquote></body>"
    df = spark.createDataFrame([(i, "http://c.example.com/", x) for i, x in enumerate(other + [copied] * 5)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.main_text(df).collect()}
    assert [got[i] for i in range(9)] == [f"Story {i}" for i in range(4)] + ["The only one of its kind"] * 5


def test_caps_of_depth_and_words_lose_no_meaning():
    def main(html):
        return [t for path, t, _ in h.texts(h.parse(html)) if h.place(path) == 1]

    deep = lambda inner: f"<div><article><p>a</p>{'<div>' * 60}{inner}{'</div>' * 60}<p>rest</p></article></div><p>out</p>"
    assert main(deep("x")) == ["a", "x", "rest"]
    assert main(deep("<nav>menu</nav><aside>see</aside><div class=ad-slot>buy<nav><p>n</nav></div>y")) == ["a", "y", "rest"]
    assert main("<div>" * 60 + "<article>b</article>c") == ["b"]
    utility = "flex mt four grow basis px font leading"
    assert main(f'<article><p>a</p><div class="{utility} sidebar">no</div><div class="{utility}" role=navigation>no</div></article>') == ["a"]
    assert main(f'<div class="{utility} has-menu" role="main">b</div>') == ["b"]
    h.parse("<div>" * 100_000 + "<li>" * 1000 + "</p>" * 1000 + "</div>" * 100_000)


def texts_of(spark, pages, host="http://t.example.com/"):
    df = spark.createDataFrame([(i, f"{host}{i}", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(h.main_text(df).collect(), key=lambda r: r.page_id)]


def test_position_decides_between_slots_of_one_path(spark):
    """Both divs have the same path, so that only the alignment tells the template's from the story; a mere union of paths would keep both."""
    pages = [f"<body><div><p>Welcome to us</p></div><div><p>Story {i}</p></div><div><p>All rights</p></div></body>" for i in range(5)]
    assert texts_of(spark, pages) == [f"Story {i}" for i in range(5)]
    pages = [f"<article><h1>T{i}</h1><section><p>Share with friends</p></section><section><p>Body {i} is told at some length</p></section></article>" for i in range(5)]
    assert texts_of(spark, pages) == [f"T{i}\n\nBody {i} is told at some length" for i in range(5)]


def test_optional_and_repeated_groups_keep_positions(spark):
    def page(i):
        notice = "<div><p>Read our terms</p></div>" if i % 2 else ""
        cards = "".join(f"<section><h2>Card {i}.{k}</h2><p>Text {i}.{k}</p></section>" for k in range(1 + i % 5))
        return f"<body><main>{cards}</main>{notice}<div><p>We are us</p></div></body>"

    want = ["\n\n".join(x for k in range(1 + i % 5) for x in (f"Card {i}.{k}", f"Text {i}.{k}")) for i in range(12)]
    assert texts_of(spark, [page(i) for i in range(12)]) == want


def test_raw_and_inline_elements_end_no_block(spark):
    pages = [
        "<article><p>a</p><script src=/x/>var a=1;</script><p>b</p></article>",
        "<article><p>Euler: <math><mi>e</mi></math> done</p><p>see <button>x</button> after <input type=text> it</p></article>",
        "<article><p>in <svg/>line <script>x</script>text</p></article>",
    ]
    assert texts_of(spark, pages) == ["a\n\nb", "Euler: done\n\nsee after it", "in line text"]


def test_words_only_break_ties(spark):
    """A word of a class doesn't drop the main text; it drops what has less than half of the text."""
    pages = [
        '<article><div class="social-history"><p>A chapter of the history of society</p></div></article>',
        '<article><div class="menu-item recipe"><p>Take three eggs and beat them well</p></div></article>',
        '<article><p>He said at length what follows here</p><blockquote class="comment">It is so</blockquote><p>And left</p></article>',
        '<article><p>The whole long story of it all, told from the beginning</p><div class="reader-feedback"><p>nice post!</p></div></article>',
        '<article><p>The whole long story of it all, told from the beginning</p><div class="ad">Buy</div><p class="advert">Now</p></article>',
        '<article><p>The whole long story</p>' + "<div>" * 50 + "<nav>menu item</nav>" + "</div>" * 50 + "</article>",
    ]
    got = [texts_of(spark, [x])[0] for x in pages]
    story = "The whole long story of it all, told from the beginning"
    assert got == ["A chapter of the history of society", "Take three eggs and beat them well", "He said at length what follows here\n\nIt is so\n\nAnd left", story, story, "The whole long story"]


def slow_common(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("vectors", [1 << 20, 1])
def test_longest_common_subsequences(monkeypatch, vectors):
    monkeypatch.setattr(h, "_VECTORS", vectors)
    rng = np.random.default_rng(2)
    for _ in range(400):
        x, y = (list(rng.choice(list("abcd"), rng.integers(0, 14))) for _ in range(2))
        got = h.common(x, y)
        assert all(x[i] == y[j] for i, j in got) and all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:])) and len(got) == slow_common(x, y)
    long = ["a", "b", "c"] * 20_000
    assert len(h.common(["x", *long], [*long, "y"])) == 60_000 if vectors > 1 else True


def random_template(rng):
    """A template as (kind, tag, inner): fixed text, a slot, an optional or a repeated part."""
    parts, word = [], lambda: "".join(rng.choice(list("abcdefgh"), 6))
    for _ in range(rng.integers(2, 7)):
        tag = str(rng.choice(["div", "section", "p", "h2", "blockquote"]))
        kind = str(rng.choice(["fixed", "slot", "optional", "repeated"]))
        parts.append((kind, tag if kind != "repeated" else "p", word()))
    return [("slot", "h1", "title"), *parts]


def render(template, rng):
    """(html, wanted blocks) of a page."""
    out, want = [], []
    for kind, tag, text in template:
        times = {"fixed": 1, "slot": 1, "optional": int(rng.integers(0, 2)), "repeated": int(rng.integers(1, 5))}[kind]
        for _ in range(times):
            own = text if kind == "fixed" else "".join(rng.choice(list("mnopqrst"), 8))
            want += [own] * (kind != "fixed")
            out.append(f"<{tag}>{own}</{tag}>")
    return f"<body><div>{''.join(out)}</div></body>", want


def tandem(tags):
    return any(tags[i : i + w] == tags[i + w : i + 2 * w] for w in (1, 2, 3) for i in range(len(tags) - 2 * w + 1))


def test_random_templates_without_any_article(spark):
    """Against the template itself: what it fixes goes, what it leaves open stays, in order."""
    rng = np.random.default_rng(11)
    rows, wanted = [], {}
    for t in range(25):
        template = random_template(rng)
        # what repeats in tandem is one group, whose places no wrapper can tell apart
        while any(tandem([x[1] for x in template if x[0] != "optional" or with_]) for with_ in (True, False)):
            template = random_template(rng)
        for _ in range(30):
            page, want = render(template, rng)
            wanted[len(rows)] = "\n\n".join(want)
            rows.append((len(rows), f"http://h{t}.example.com/", page))
    got = {r.page_id: r.text for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = [i for i, x in wanted.items() if got[i] != x]
    assert not wrong, (len(wrong), rows[wrong[0]], got[wrong[0]])


def test_every_page_matches_its_wrapper():
    rng = np.random.default_rng(12)
    for _ in range(40):
        template = random_template(rng)
        pages = [h.parse(render(template, rng)[0]) for _ in range(8)]
        wrapper = None
        for p in sorted((h.pattern(x, k) for k, x in enumerate(pages)), key=str):
            wrapper = p if wrapper is None else h.align(wrapper, p)
        m = h.Matcher(wrapper)
        assert m.size == len(list(h.slots(wrapper))) == len(h.choose(wrapper))
        for x in pages:
            found = m.slots_of(x)
            assert None not in found and len(found) == len(list(h.texts(x)))


def test_large_tables_are_shuffled_alike(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = sorted(map(str, h.main_text(df).collect()))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(h, "_HELD", 1)
    monkeypatch.setattr(h, "PORTION", 2)
    assert sorted(map(str, h.main_text(df).collect())) == want


def test_null_hosts_repeated_rows_and_very_deep_or_wide_pages(spark):
    deep = "<section><div>" * 400 + "<p>deep</p>" + "</div></section>" * 400
    wide = "<article>" + "".join(f"<p>{k}</p><h2>{k}</h2>" for k in range(3000)) + "</article>"
    rows = [(k, None, x, "c") for k, x in enumerate([deep, wide, None, "", deep])] * 2
    got = h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 10 and by[0] == by[4] == "deep" and by[1].count("\n\n") == 5999 and by[2] == by[3] == ""


def test_a_story_under_many_titles_is_no_template(spark):
    pages = [f"<nav>n{i}</nav><article><h1>Title {i}</h1><p>The same long story on every page of the host</p><div><p>Share it</p></div></article>" for i in range(5)]
    assert texts_of(spark, pages[:5]) == [f"Title {i}\n\nThe same long story on every page of the host\n\nShare it" for i in range(5)]
