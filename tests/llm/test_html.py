"""Pages parsed, aligned and cut, against plain versions and planted articles."""

import random

import pytest
from pyspark.sql import functions as F

from marquee.llm import html_extraction as x
from marquee.llm.dom import MAX_DEPTH, align, outline, parse, walk

PAGES = "page_id bigint, url string, html string, host int, skeletons string, text string"


def words(rnd, n):
    return " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(n))


def text_of(html, template=()):
    page = x.Page(html)
    page.judge(set(template))
    return page.text()


def size_of_matching(a, b):
    """Simple tree matching in its plain recursive form."""
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, p in enumerate(a.kids):
        for j, q in enumerate(b.kids):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size_of_matching(p, q))
    return 1 + best[-1][-1]


def test_alignment_is_a_largest_matching():
    rnd = random.Random(3)

    def tree(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice(["one ", "two "])
        tag = rnd.choice(["div", "span", "b"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rnd.randint(1, 4))) + f"</{tag}>"

    for _ in range(150):
        a, b = parse(tree(4)), parse(tree(4))
        pairs = align(a, b)
        up_a, up_b = set(), set()
        partner = {}
        for p, q in pairs:
            while p is not None:
                assert p.label == q.label and partner.setdefault(p.at, q.at) == q.at
                up_a.add(p.at), up_b.add(q.at)
                p, q = p.up, q.up
        assert len(up_a) == len(up_b)
        places = [(p.at, q.at) for p, q in pairs]
        assert [q for _, q in sorted(places)] == sorted(q for _, q in places)
        # elements without matched texts below aren't reported, so texts alone can't exceed it
        assert len(up_a) <= size_of_matching(a, b) or not pairs


def test_long_lists_align_by_equal_children():
    a = "<ul>" + "".join(f"<li>{i}</li>" for i in range(400)) + "</ul>"
    b = "<ul>" + "".join(f"<li>{i}</li>" for i in range(100, 500)) + "</ul>"
    pairs = align(parse(a), parse(b))
    assert len(pairs) == 300 and all(p.text == q.text for p, q in pairs)


@pytest.mark.parametrize(
    "html, wanted",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><p>a<p>b<ul><li>c<li>d</ul>e</article>", "a\nb\nc\nd\ne"),
        ("<article><p><b>x<br><p>y  \n z</p></article>", "x\ny z"),
        ("<article><p>1 < 2 &am &lt;b&gt; &#65;&nbsp;B</p></article>", "1 < 2 &am <b> A B"),
        ("<article><p>kept<!-- gone --> on</p><script>'</p>'</script><style>p{}</style></article>", "kept on"),
        ("<article><p>cut in a <a href='x", "cut in a"),
        ("<article><h1>T</h1><p>a <b>b</b><i>c</i></p></article><footer>f</footer>", "T\na bc"),
        ("<main><p>m</p><aside>no</aside><form><p>no</p></form></main>", "m"),
        ("<article><header><h1>T</h1></header><p>a</p><footer>by</footer></article>", "T\na"),
        ("<div id='comments'><article><p>" + "long " * 50 + "</p></article></div><article><p>a</p></article>", "a"),
        ("<article><p>a</p><div class='ad-box'>buy</div><div class='cookieNotice'>ok</div></article>", "a"),
        ("<body class='has-sidebar'><div class='page with-sidebar'><article><p>a</p></article></div></body>", "a"),
        ("<div class='menu'><a href=1>x</a></div><div><div><h1>T</h1><p>" + "w " * 30 + "</p></div></div>",
         "T\n" + ("w " * 30).strip()),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p>a</p></article></body></html> ", "a"),
        ("<script>never closed <article>no</article>", ""),
        ("<title>no</title><p>a", "a"),
    ],
)
def test_pages(html, wanted):
    assert text_of(html) == wanted


def test_deep_and_odd_pages():
    deep = "<div>" * 5_000 + "bottom" + "</div>" * 5_000
    assert text_of(deep) == "bottom"
    tree = parse("<div>" * 5_000 + "x")
    depth = 0
    while tree.kids:
        tree, depth = tree.kids[0], depth + 1
    assert depth <= MAX_DEPTH + 1
    rnd = random.Random(1)
    for _ in range(300):
        soup = "".join(rnd.choices(["<p>", "</p>", "<b", ">", "<", "/", "a", "'", '"', "<!--", "-->",
                                    "<script>", "</script>", "<td>", "</table>", "&", "</div>", "<ul><li>"], k=40))
        page = parse(soup)
        assert [n.at for n in walk(page)] == list(range(sum(1 for _ in walk(page))))
        text_of(soup), align(page, parse(soup[::-1])), outline(page)


def site(rnd, n, host, copies=0):
    """Pages of one site whose template has a notice without any telling mark."""
    out, same = [], None
    for i in range(n):
        blocks = [words(rnd, rnd.randint(4, 30)) for _ in range(rnd.randint(1, 6))]
        if i < copies:
            same = same or blocks
            blocks = same
        body = "".join(f"<p>{b}</p>" for b in blocks)
        html = (
            f"<html><body><div class='x1'>{words(rnd, 2)}</div><article><h1>{i if i >= copies else 'h'}</h1>"
            f"<div class='x2'>Read all about it in our paper</div>{body}<p>Printed by the press.</p>"
            f"</article><div class='x3'>{words(rnd, 9)}</div></body></html>"
        )
        title = str(i) if i >= copies else "h"
        out.append((f"http://{host}/{i}", html, "\n".join([title, *blocks])))
    return out


def test_template_is_left_out_and_copies_are_not_template(spark):
    rnd = random.Random(5)
    # on the second site half of the pages are one article, on the third nearly all
    rows = site(rnd, 60, "a.example") + site(rnd, 60, "b.example:80", 30) + site(rnd, 60, "c.example", 50)
    few = site(rnd, 3, "d.example")
    table = [(i, u, h, 0, "", "") for i, (u, h, _) in enumerate(rows + few)]
    df = spark.createDataFrame(table, PAGES).repartition(5)
    got = {r["page_id"]: r for r in x.main_text(df).collect()}
    assert len(got) == len(table)
    for i, (_, _, wanted) in enumerate(rows):
        assert got[i]["text"] == wanted
        assert got[i]["n_chars"] == len(wanted)
    for i, (_, _, wanted) in enumerate(few, len(rows)):  # too few pages to tell
        title, _, rest = wanted.partition("\n")
        assert got[i]["text"] == f"{title}\nRead all about it in our paper\n{rest}\nPrinted by the press."


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, None, 0, "", ""), (1, None, "<p>a</p>", 0, "", ""), (1, "http://h/", "", 0, "", ""),
            (1, "http://h/", "<p>b</p>", 0, "", ""), (2, "nonsense", "<p>c", 0, "", "")]
    df = spark.createDataFrame(rows, PAGES)
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in x.main_text(df).collect())
    assert got == [(0, "", 0), (1, "", 0), (1, "a", 1), (1, "b", 1), (2, "c", 1)]
    assert x.main_text(df.limit(0)).count() == 0


def test_host(spark):
    urls = ["HTTP://U:p@A.example:8080/x?y#z", "a/b", None, "https://b.example", "ftp://c.example#t"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in df.select(x.host(F.col("url"))).collect()]
    assert got == ["a.example", "", "", "b.example", "c.example"]
