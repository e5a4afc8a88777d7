"""Main text of pages: the reader against broken markup, labels and site trees against pages built here."""

import math
import os
import random
import re
from collections import Counter, defaultdict
from html import unescape

import pytest
from pyspark.sql import functions as F

from hiregrain.llm import checks, markup, sitetree

PAGES = "page_id long, url string, html string, text string, site string, node int, page int, kind string"
SF = "/root/testdata/sf0.001"


def extracted(spark, rows):
    table = spark.createDataFrame([(*r, "old", "clash", 1, 2, "k") for r in rows], PAGES)
    found = sitetree.extract(table)
    assert set(found.columns) == {"page_id", "url", "text", "n_chars", "site", "node", "page", "kind"}
    rows = found.collect()
    assert all(r.n_chars == len(r.text) and r.site == "clash" for r in rows)
    return sorted(((r.page_id, r.text) for r in rows), key=str)


def text_of(html):
    page = markup.read_page(html)
    return sitetree.main_text(page, set())


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b<br>c<b>d</b>e", "a b cde"),
        ("<div>a &lt;b&gt; &#x41;&#66;&nbsp;c &am &copy x</div>", "a <b> AB c &am © x"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<script>if (a < b) document.write('<p>no</p>')</script><p>yes", "yes"),
        ("<style>p{}</style><!-- <p>no</p> --><p>yes<!-- never ends <p>no", "yes"),
        ("<SCRIPT>x</SCRIPT ><P CLASS=Body>yes</P>", "yes"),
        ("<p title='a > b' class=\"x\">yes</p>", "yes"),
        ("<p title='it never ends>yes</p>", "yes"),
        ("<textarea><p>no</textarea><title>no</title>yes<iframe>no", "yes"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", "a b c d"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "a b c"),
        ("<b><p>a</b>b</p>c", "ab c"),
        ("</div></p><p>a</span></div>b", "a b"),
        ("<p>un<i>believ</i>able  \n\t story</p>", "un believable story".replace("un b", "unb")),
        ("<nav><a href=/>menu</a></nav><article><h1>T</h1><p>a</p><aside>no</aside><div class='share-buttons'>no</div></article><footer>no</footer>", "T a"),
        ("<div class=wrap><article>a</article><p>outside</p></div>", "a"),
        ("<form id=aspnet><div class=content><p>a</p></div><div class=sidebar>no</div></form>", "a"),
        ("<div class='page has-sidebar'><p>a</p><div id=sidebar>no</div></div>", "a"),
        ("<article class='post comments-open'>a</article><section id=comments><article>no</article></section>", "a"),
        ("<article>a</article><article class=comment>no</article>", "a"),
        ("<main><h1>T</h1><p>a</p><div role=navigation>no</div></main><p>outside", "T a"),
        ("<div itemprop=articleBody>a <button>no</button>b<span class=ad>no</span></div>", "a b"),
        ("<p>a</p><div hidden>no</div><div style='display: none'>no</div><div class=cookieNotice>no</div><div class='advent'>b</div>", "a b"),
    ],
)
def test_page_reader(html, text):
    assert text_of(html) == text


def test_deep_and_long_pages():
    assert text_of("<div>" * 5_000 + "deep" + "</div>" * 5_000) == "deep"
    assert text_of("<p " * 50_000) == ""
    assert text_of("<a '" * 3_000 + "<" * 50_000) == ""
    counts = list(sitetree.page_counts(markup.read_page("<ul><li>" * 2_000 + "deep")))
    assert max(len(c[-1] or ()) for c in counts) == markup.DEEPEST
    assert len(text_of("word " * 400_000)) == 2_000_000 - 1


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))


def site(rng, n, host):
    """Pages of a template whose markup says nothing: its boilerplate can be told by the site alone."""
    teaser = words(rng, 9)
    pages, wanted = [], []
    for i in range(n):
        body = [words(rng, 12) for _ in range(rng.randint(1, 6))]
        html = (
            f"<div class=q1><a href=/>{'Home'}</a> <a href=/a>About us</a></div><div class=q2><p>We use small files, see page {i}.</p></div>"
            f"<div class=q3><h2>{body[0][:20]}</h2>" + "".join(f"<p>{b}</p>" for b in body) + f"<p>Quoted on every page of all</p></div><div class=q4><p>{teaser}</p></div>"
        )
        pages.append((i, f"https://user@{host.upper()}:8080/p/{i}?x#y", html))
        wanted.append((i, " ".join([body[0][:20], *body, "Quoted on every page of all"])))
    return pages, wanted


def test_site_tree_finds_unlabelled_boilerplate(spark):
    rng = random.Random(1)
    pages, wanted = site(rng, 40, "news.example")
    assert extracted(spark, pages) == sorted(wanted, key=str)
    few = extracted(spark, pages[:3])  # three pages tell little: all but links stays
    assert all("We use small files" in text for _, text in few)


def test_copies_do_not_turn_articles_into_boilerplate(spark):
    rng = random.Random(2)
    body = [words(rng, 12) for _ in range(4)]
    copy = "<div class=q3>" + "".join(f"<p>{b}</p>" for b in body) + "</div>"
    near = [copy.replace(body[0], words(rng, 12)) for _ in range(30)]
    pages, wanted = site(rng, 30, "a.example")
    pages += [(100 + i, "http://a.example/c", copy) for i in range(60)] + [(200 + i, "http://a.example/n", n) for i, n in enumerate(near)]
    got = dict(extracted(spark, pages))
    assert all(got[i] == t for i, t in wanted)
    assert all(got[100 + i] == " ".join(body) for i in range(60))
    assert all(got[200 + i].endswith(" ".join(body[1:])) and len(got[200 + i].split()) == 48 for i in range(30))


def test_importance_by_brute_force(spark):
    """The whole tree, from the formulas in the module's description."""
    rng = random.Random(5)
    pages, _ = site(rng, 12, "x.example")
    pages.append((99, "http://x.example", pages[0][2]))  # a copy counts once
    styles, texts, holders, chars, linked, ways = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter)), defaultdict(set), Counter(), Counter(), {}
    for html in {p[2] for p in pages}:
        for kind, node, value, n, links, _, path in sitetree.page_counts(markup.read_page(html)):
            if kind == sitetree.STYLE:
                styles[node][value] += n
            elif kind == sitetree.TEXT:
                texts[node][value][html] += n
            else:
                holders[node].add(html)
                chars[node] += n
                linked[node] += links
                ways[node] = path

    def entropy(counts):
        total = sum(counts)
        return -sum(c / total * math.log(c / total) for c in counts)

    def composite(node):
        m = len(holders[node])
        below = [x for x in ways if node in ways[x]]
        own = [1 - (entropy(t.values()) / math.log(len(holders[x])) if len(holders[x]) > 1 else 0) for x in below for t in texts[x].values()]
        content = max(0, sum(own) / len(own)) if own else 0
        presentation = min(1, entropy(styles[node].values()) / math.log(m)) if m > 1 else 1
        weight = sitetree.GAMMA ** len(styles[node])
        links = sum(linked[x] for x in below) / (sum(chars[x] for x in below) or 1)
        return ((1 - weight) * presentation + weight * content) * (1 - links)

    want = {}
    for node, path in ways.items():
        value = 1.0
        for above in path:
            value = (sitetree.FEW * value + len(holders[above]) * composite(above)) / (sitetree.FEW + len(holders[above]))
        want[node] = value
    table = spark.createDataFrame([(p[1], p[2]) for p in pages], "url string, html string")
    counted = table.select(sitetree.site_of(table.url).alias("site"), F.md5("html").alias("page"), "html")
    tree = sitetree.style_tree(counted.mapInArrow(sitetree._counts_of, sitetree.COUNTS)).collect()
    got = {r.node % (1 << 64): r.importance for r in tree}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert 0 < sum(v < sitetree.THRESHOLD for v in got.values()) < len(got)


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (2, "not a url", None), (None, "", ""), (3, "//h/x", "<div/><p>b"), (4, "ftp://h", " \n "), (5, "http://h", "<p>" + "long " * 100_000)]
    got = extracted(spark, rows)
    assert got == sorted([(1, "a"), (1, "a"), (2, ""), (None, ""), (3, "b"), (4, ""), (5, ("long " * 100_000).strip())], key=str)
    assert extracted(spark, []) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_query_on_the_given_pages(spark):
    """On the given template the main text is the article's blocks, which a few replacements can tell as well."""
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = checks.op13_pages(spark, SF).collect()
    assert len(found) == len(source)
    for r in found:
        inside = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        assert r.text == " ".join(unescape(re.sub(r"<b>|</b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inside))).split())
