import random

import pytest
from reviewlens.llm import page_text as pt

SHELL = ("<!DOCTYPE html><html><head><title>{t}</title><style>p{{x}}</style><script>var t='</p>';</script></head>"
         "<body><div class='top-banner'>{b}</div><ul id=\"main-menu\">{menu}</ul>{main}"
         "<div class='comments'><p>Nice one {c}</p></div><footer>&copy; {t}</footer></body></html>")


def site(rng, i):
    """A page without semantic tags: the text region is found by its content."""
    words = [f"w{rng.randrange(900)}" for _ in range(200)]
    text = [" ".join(words[k:k + 25]) for k in range(0, 25 * rng.randint(2, 7), 25)]
    body = f"<h2>Head {i}</h2>" + "".join(
        f"<p>{p[:30]}<b>{p[30:]}</b>" + (" <a href=x>more</a>" if k % 2 else "") for k, p in enumerate(text))
    fixed = "<div>Read our terms before use of this page, all rights are ours</div>"
    page = SHELL.format(t=f"T{i}", b="Buy", c=i, menu="<li><a href=/a>A</a>" * rng.randint(1, 6),
                        main=f"<div class=box><div class=text>{body}{fixed}"
                             f"{'<form><p>mail</p></form>' if i % 3 else ''}</div></div>"
                             "<div>Short line</div>")
    want = [f"Head {i}"] + [p + (" more" if k % 2 else "") for k, p in enumerate(text)]
    return page, "\n\n".join(want)


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3) \
        .selectExpr("*", "'a' AS host", "'b' AS text", "'c' AS fixed", "1 AS part")


def test_wrapper_finds_the_text_of_plain_sites(spark, monkeypatch):
    monkeypatch.setattr(pt, "FAN", 2)
    rng = random.Random(2)
    made = [site(rng, i) for i in range(30)]
    rows = [(i, f"http://Site.example:80/p{i}?q=//x", p) for i, (p, _) in enumerate(made)]
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in pt.main_texts(frame(spark, rows)).collect()}
    assert {i: g[1] for i, g in got.items()} == {i: want for i, (_, want) in enumerate(made)}
    assert all(g[2] == len(g[1]) and g[0] == rows[i][1] for i, g in got.items())
    found = pt.wrapper_expressions(frame(spark, rows)).collect()
    assert [(r.host, r.pages) for r in found] == [("site.example", 30)]
    e = found[0].expression
    assert "(<p>#</>)+" in e and "(<form~>" in e and ")?" in e and "<div>=</>" in e and "<h2>#</>" in e


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain &lt;b&gt; &amp;amp; text", "plain <b> &amp; text"),
    ("<nav>menu</nav><p>cut <b>off</b> he<a href='x", "cut off he"),
    ("<article><h1>T</h1><p><b>One.<br><p>Two\n\t three&nbsp;four</p><aside>no</aside>"
     "<p>a<script>x</script>b <span class='ad-slot'>buy</span>c</article><p>other", "T\n\nOne.\n\nTwo three four\n\nab c"),
    ("<main><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><section id=userComments><p>c</section></main>",
     "a\n\nb\n\n1\n\n2"),
    ("<body><header>logo</header><article><header><h1>H</h1></header>x<!-- no --> y<br>z</article>", "H\n\nx y z"),
    ("a < b <3 & c <!-- open", "a < b <3 & c"),
    ("<p>x <a href=1>l</a> <a href=2>m</a>.</p>", "x l m."),
    ("<p style='display:none'>no</p><p hidden>no</p><p>yes</p>", "yes"),
])
def test_single_pages(page, text):
    assert pt.main_text(page, {}) == text


def test_repeats_options_and_bounds():
    one, two = (pt.wrapper_of(pt.parse(h), n) for n, h in enumerate((
        "<dl><dt>a<dd>b<dt>c<dd>d</dl><hr><p>x", "<dl><dt>a<dd>b</dl><div>z</div><p>y")))
    assert pt.expression(pt.merge(one, two)) == "<dl>(<dt>#</> <dd>#</>)+</> (<div>#</>)? <p>#</>"
    wide = "".join(f"<x{i}>t</x{i}><h{1 + i % 6}>h</h{1 + i % 6}><div>d</div>" * (1 + i % 2) for i in range(300))
    assert len(pt.expression(pt.wrapper_of(pt.parse(wide), 1))) < 500
    deep = "<div>" * 5000 + "deep <script>no" + "</div>" * 10
    assert pt.main_text(deep, {}) == "deep"


def test_odd_rows(spark):
    same = "<article><div>All copies say this</div></article>"
    rows = [(1, None, "<p>no url</p>"), (2, "u", None), (3, "http://a/", ""), (None, "http://b/", "<p>no id</p>"),
            (4, "http://c/", "<p>" + "long " * 200000), *[(5, "http://d/", same)] * 8]
    got = sorted(((r.page_id or 0, r.url, r.text) for r in pt.main_texts(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, None, "no url"), (2, "u", ""), (3, "http://a/", ""), (0, "http://b/", "no id"),
                          (4, "http://c/", ("long " * 200000).strip()),
                          *[(5, "http://d/", "All copies say this")] * 8], key=str)
    assert pt.main_texts(frame(spark, [])).collect() == []
