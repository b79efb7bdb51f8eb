"""HTML extraction: held-out layouts, the given layout, markup edge cases, defined results."""

import itertools

import numpy as np
import pytest

from lithoscope.llm.html_extract import ChainField, default_field, extract_text, labelled_blocks, labelled_pages, leaf_blocks, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";track(1);</script></head><body>
<nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy a thing now.</div>
<article><h1>A title, here</h1><p><b>First &amp; foremost, a sentence<br>that ends.<p>Second para&shy;graph &#x41;&nbsp; b.</p></article>
<footer>&copy; site &middot; words.</footer></body></html>"""


def test_given_layout():
    assert main_text(PAGE, default_field()) == "A title, here First & foremost, a sentence that ends. Second para\xadgraph A b."


ONE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda. Mu nu xi omicron pi rho sigma tau."
TWO = "A second paragraph of some length says a few things about rivers, stones and light, and then ends."
NAV, FOOT = '<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B b</a></li></ul></nav>', "<footer>&copy; some site 2024</footer>"


@pytest.mark.parametrize("page, want", [
    (f"<body><h1>Title</h1><p>{ONE}</p><p>{TWO}</p></body>", f"Title {ONE} {TWO}"), (f"<body>{NAV}<h1>Title</h1><p>{ONE}</p><p>{TWO}</p>{FOOT}</body>", f"Title {ONE} {TWO}"),
    (f"<div><p>{ONE}</p><p>{TWO}</p></div>", f"{ONE} {TWO}"), (f"<section><p>{ONE}</p></section>", ONE), (f"<table><tr><td><p>{ONE}</p></td></tr></table>", ONE),
    (f'<div id="wrapper"><div class="col-8"><p>{ONE}</p></div></div>', ONE), (f"{ONE} {TWO}", f"{ONE} {TWO}"), ("Hello world", "Hello world"), (f"<p>{ONE}</p>" * 7, " ".join([ONE] * 7)),
    (f'<article class="review"><p>{ONE}</p></article>', ONE), (f'{NAV}<article class="post comments-open"><h1>T</h1><p>{ONE}</p></article>{FOOT}', f"T {ONE}"), (f"<main><p>{ONE}</p></main>", ONE),
    (f'<div class="cookie-notice">We use cookies. Accept</div><p>{ONE}</p>', ONE), (f"<form><label>Name</label><p>{TWO}</p></form><p>{ONE}</p>", ONE),
    (f'<article><h1>T</h1><p>{ONE}</p></article><section class="comments"><article class="comment"><p>{TWO}</p></article></section>', f"T {ONE}"),
    (f'{NAV}<div class="ad">Buy cheap things</div><article><p>{ONE}</p></article><aside><h3>Related</h3><p>{TWO}</p></aside>{FOOT}', ONE)])
def test_pages_with_and_without_a_container(page, want):
    assert main_text(page, default_field()) == want


def test_held_out_layouts():
    wrong = total = 0
    for rows, labels in labelled_blocks(labelled_pages(120, seed=5)):
        wrong += sum(a != b for a, b in zip(default_field().decode([default_field().weigh(r) for r in rows]), labels))
        total += len(labels)
    assert wrong <= 0.01 * total


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(3)
    for _ in range(30):
        gains = draw.normal(size=5)
        field = ChainField({str(k): g for k, g in enumerate(gains)}, draw.normal(size=(2, 2)).tolist(), draw.normal(size=2).tolist())

        def worth(path):
            return field.start[path[0]] + sum(g * y for g, y in zip(gains, path)) + sum(field.step[a][b] for a, b in itertools.pairwise(path))

        best = max(itertools.product((0, 1), repeat=5), key=worth)
        assert tuple(field.decode([field.weigh([str(k)]) for k in range(5)])) == best


def test_markup_edges():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts(None) == texts("") == texts("  \n") == []
    assert texts("a < b <i>c</i>d") == ["a < b cd"]
    assert texts("<ul><li>x<li>y</ul>z") == ["x", "y", "z"]
    assert texts("<p title='a>b'>q</p><!-- <p>no</p> --><script>1<2</script>r") == ["q", "r"]
    assert texts("<div>open <b>never closed") == ["open never closed"]
    assert texts("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>mc</mi></math> as shown</p>") == ["Energy is E=mc as shown"]
    assert texts("<p>see <object data='x'>the fallback words</object> <svg><path d='m'/><text>A</text></svg> on") == ["see the fallback words A on"]
    assert texts("<p>a <select><p>b <video src='x'/>c <object/>d") == ["a", "b c d"]  # without end tags nothing is skipped
    assert texts("<p>a<select><option>no</select>b<textarea>the rest") == ["ab"]
    assert texts("<textarea>no</textarea><p>a&lt;b&amp;amp;") == ["a<b&amp;"]


def test_defined_results(spark):
    rows = [(1, "u", None, "extra"), (None, None, PAGE, "x"), (2, "u", PAGE, "y"), (2, "u", PAGE, "y"), (3, "u", "<p>" + "word " * 200_000, None)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got)[:4] == [(0, 76), (1, 0), (2, 76), (2, 76)]
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
