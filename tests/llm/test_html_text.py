import time

import numpy as np
import pytest
from fluxmesh.llm.html_text import KERNEL, extract_text, main_blocks, parse, path_scores

LONG = "One sentence, of the article. Another one; with commas, too. And a third sentence that ends the paragraph."
OTHER = "A second paragraph, quite unlike the first. It has its own commas, points and words."


def page(body, head="<title>T</title><script>if (a<b) x='</p>';</script><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body class='has-sidebar'>{body}</body></html>"


CASES = {
    "plain": (page(f"<nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><article><h1>Title here</h1><p>{LONG}</p><p>{OTHER}</article><footer>&copy; someone.</footer>"), ["Title here", LONG, OTHER]),
    "short article among long others": (
        page(f"<div class='ad'>{LONG} {LONG}</div><article><h1>Hi</h1><p>Short.</p></article><section id=comments><p>{OTHER} {LONG}</p></section><form><p>{LONG}</p></form>"),
        ["Hi", "Short."],
    ),
    "no article element": (page(f"<div class=menu><a href=/>Home</a> <a href=/b>Blog</a></div><div id=c1><h1>Head</h1><p>{LONG}</p><p>{OTHER}</p><p>Yes.</p></div><div class=side2><a href=/1>Read one</a></div>"), ["Head", LONG, OTHER, "Yes."]),
    "lists, quotes and tables of the article stay": (
        page(f"<main><h1>H</h1><p>{LONG}</p><ul><li>milk<li>bread</ul><blockquote>So be it</blockquote><table><tr><td>a<td>b<tr><td>c</table><p>{OTHER}</p><ul><li><a href=/t1>tag one</a><li><a href=/t2>tag two</a></ul></main>"),
        ["H", LONG, "milk", "bread", "So be it", "a", "b", "c", OTHER],
    ),
    "references and white space": (page(f"<article><p>{LONG} &amp;amp; &lt;b&gt; &#233;&eacute;&#x1F600;\n\n x<b>y</b> 1<br>2 &nbsp;3 a < b</p></article>"), [f"{LONG} &amp; <b> éé\U0001f600 xy 1 2 3 a < b"]),
    "comments of readers and notices": (
        page(f"<div class='cookie-notice'><p>{LONG}</p></div><article><header><h1>Head</h1><p>by someone</p></header><p>{OTHER}</p><p>{LONG}</p><aside>{LONG}</aside><footer>filed</footer></article><article class='comment'><p>{LONG} {LONG} {LONG}</p></article>"),
        ["Head", OTHER, LONG],
    ),
    "a form around the page": (page(f"<form action=/><div><h1>Head</h1><p>{LONG}</p><p>{OTHER}</p></div></form>"), ["Head", LONG, OTHER]),
    "teasers in a sidebar": (page(f"<aside><article><p>{LONG}</p></article></aside><article><p>{OTHER}</p></article>"), [OTHER]),
    "hidden": (page(f"<article><p>{LONG}</p><p hidden>{OTHER}</p><p style='display: none'>{OTHER}</p></article>"), [LONG]),
    "breaks in pairs": (page(f"<div>{LONG}<br><br/>{OTHER}<br>same</div>"), [LONG, f"{OTHER} same"]),
    "no head end, no body": (f"<head><title>t</title><p>{LONG}<p>{OTHER}", [LONG, OTHER]),
    "comment and doctype marks": (f"<!-- <p>{LONG}</p> --><!----><article><![CDATA[x]]><p a='>' b=\"<p>\">{LONG}</p><?php x ?><!--> {OTHER}<!-- open", [LONG, OTHER]),
    "only links": (page("<ul><li><a href=/>one</a><li><a href=/>two</a></ul>"), []),
    "ends that never come": (page(f"<article><button>press<p>{LONG}</p></em></section></article></div><a href=/>x"), ["press", LONG]),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    source, want = CASES[name]
    assert main_blocks(source) == want


def test_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "just words", None), (None, CASES["plain"][0], 7), (5, CASES["plain"][0], 7), (5, CASES["plain"][0], 7), (6, "<", 1), (7, "<p", 1), (8, "</", 1), (9, "<!--", 1), (10, "<a b='", 1)]
    docs = spark.createDataFrame(rows, "page_id long, html string, text int")
    out = {(r.page_id, i): r for i, r in enumerate(extract_text(docs, ["page_id"]).collect())}
    assert len(out) == len(rows)
    by = {i: r for (i, _), r in out.items()}
    assert by[1].text == by[2].text == by[10].text == "" and by[1].n_chars == by[1].n_blocks == 0
    assert by[3].text == "just words" and by[6].text == "<" and by[8].text == "</"
    assert by[None].text == by[5].text == "\n\n".join(CASES["plain"][1]) and by[5].n_chars == len(by[5].text)
    kept = extract_text(docs.withColumnRenamed("text", "own_html"), ["page_id", "own_html"])
    assert kept.columns == ["page_id", "own_html", "text", "n_chars", "n_blocks"] and kept.where("own_html = 7").count() == 5
    assert extract_text(docs.limit(0), ["page_id"]).count() == 0


def test_scores_by_plain_sums():
    rng = np.random.default_rng(2)
    paths = rng.integers(0, 5, 40)
    lengths, marks = rng.integers(1, 200, 40), rng.integers(0, 9, 40)
    linked = np.minimum(rng.integers(0, 60, 40), lengths)
    score, share = path_scores(lengths, marks, linked, paths)

    def smooth(x):
        ratio = [sum(x[paths == p]) / sum(paths == p) for p in paths]
        node = []
        for i in range(40):
            near = [(KERNEL[2 + d], ratio[i + d]) for d in range(-2, 3) if 0 <= i + d < 40]
            node.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
        return np.array([np.mean([node[j] for j in range(40) if paths[j] == p]) for p in paths])

    links = np.array([sum(linked[paths == p]) / sum(lengths[paths == p]) for p in paths])
    assert np.allclose(share, links) and np.allclose(score, smooth(lengths - linked) * (1 + smooth(marks)) * (1 - links))


@pytest.mark.parametrize(
    "source",
    ["<div>" * 60_000 + "x", "<div>" * 30_000 + "</section>" * 30_000 + "x", "<li>" * 60_000, "<p a=\"" * 60_000, "<div " + "a" * 300_000 + ">x", "<!" * 100_000, "<button>" * 40_000 + "x", "<textarea " * 40_000, "a <b" * 60_000, "<div class='" + "aB" * 100_000 + "'>x", "&" * 300_000],
    ids=range(11),
)
def test_damage_takes_linear_time(source):
    start = time.process_time()
    main_blocks(source)
    assert time.process_time() - start < 6


def test_paths_repeat():
    found = parse("<div class=a1><p>x<p>y</div><div class=a2><p>z</div>")
    assert [found.path[o] for o in found.owner] == [2, 2, 2]  # digits of a class are no part of a path
