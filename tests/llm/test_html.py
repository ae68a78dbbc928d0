from itertools import product

import pytest

from rubricon.llm import htmltext


@pytest.fixture(scope="module")
def field():
    return htmltext.trained()


BODY = "The first sentence of a story is here, with some length. And a second one follows it."


def test_layouts(field):
    cases = {
        f"<html><head><title>T</title></head><body><nav><a href=1>Home</a></nav><article><h1>Big news</h1><p>{BODY}</p><p>{BODY} &amp; more</p></article><footer>&copy; Site</footer></body></html>": f"Big news\n{BODY}\n{BODY} & more",
        f'<div id="menu"><ul><li><a href="/">One</a><li><a href="/">Two</a></ul></div><div class="content"><h1>Title</h1><p>{BODY}<p>a\n  b&nbsp;c {BODY}</div><div class="sidebar"><h3>Related</h3><a href="/x">Other</a></div><div class="comments"><p>I like this story. Really good.</p></div>': f"Title\n{BODY}\na b c {BODY}",
        f'<body><div class="cookie-notice">We use cookies. Accept?</div><main><h1>Head line</h1><p>{BODY}</p><div class="ad">Buy now.</div><p>{BODY}</p></main><form>Name <input></form></body>': f"Head line\n{BODY}\n{BODY}",
    }
    for page, text in cases.items():
        assert htmltext.main_text(page, field) == text


def test_blocks_of_broken_markup():
    found = [b.text for b in htmltext.blocks('<p>one <b>two<p title="a > b">three<br>four <script>if (a < b) "</p>"</script><li>five<!-- x --><td>six & seven &lt;8 <9')]
    assert found == ["one two", "three four", "five", "six & seven <8 <9"]
    assert htmltext.blocks("") == [] and htmltext.blocks("<") != None  # noqa: E711


def test_viterbi_is_the_best_sequence(field):
    pages = htmltext.labelled_pages(30, seed=99)
    for chain, _ in pages:
        chain = chain[:9]
        if not chain:
            continue
        lean = [field.lean(b) for b in chain]

        def score(states):
            total = field.start[states[0]] + sum(x for x, s in zip(lean, states) if s)
            return total + sum(field.step[a][b] for a, b in zip(states, states[1:]))

        best = max(product((0, 1), repeat=len(chain)), key=score)
        assert score(tuple(field.decode(chain))) == pytest.approx(score(best))


def test_unseen_layouts(field):
    pages = htmltext.labelled_pages(200, seed=12345)
    hits = [s == y for chain, labels in pages for s, y in zip(field.decode(chain), labels)]
    assert sum(hits) / len(hits) > 0.95


def test_driver_pages(spark, field):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = htmltext.extracted(pages, field).collect()
    assert len(rows) == pages.count()
    for r in rows:
        want = [b.text for b in htmltext.blocks(r.html) if any(e.split()[0] == "article" for e in b.path)]
        assert r.text == "\n".join(want)


def test_odd_rows(spark, field):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", None), (3, "plain text only, nothing else. Really.", "b"), (4, "<p>" * 30_000 + "x", "c")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = htmltext.extracted(pages, field).collect()
    assert len(out) == 5 and [r.text for r in out if not r.html] == [""] * 3
    assert htmltext.extracted(pages.limit(0), field).collect() == []
