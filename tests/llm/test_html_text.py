import numpy as np
import pytest

from lectern.llm import html_text as h
from lectern.llm.sample_pages import sample_page


@pytest.fixture(scope="module")
def weights():
    return h.trained()


def text_of(html, weights):
    return h.main_texts([html], weights, h.WordRows(), h.Bits())[0]


def test_held_out_pages(weights):
    rng, words = np.random.default_rng(123), h.WordRows()
    right = total = 0
    for _ in range(150):
        html, kept = sample_page(rng)
        page = h.leaves(html)
        if page:
            z = h.logits(weights, [page], words)[0]
            right += sum((v > 0) == (x.text in kept) for v, x in zip(z, page))
            total += len(page)
    assert right / total > 0.97


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4, 2, h.INPUT)).astype(np.float32)
    mask = np.ones((4, 2), np.float32)
    mask[3, 1] = 0
    w = h.Weights(*(rng.normal(0, 0.3, s).astype(np.float64) for s in ((2, h.INPUT, 4 * h.HIDDEN), (2, h.HIDDEN, 4 * h.HIDDEN), (2, 4 * h.HIDDEN), (2 * h.HIDDEN,), (1,))))
    up = rng.normal(size=(4, 2, h.HIDDEN))
    grads = h.Weights(*[np.zeros_like(a) for a in w.arrays()])
    saved = []
    h.forward(w, 0, x @ w.wx[0] + w.b[0], mask, saved)
    h.backward(w, 0, x, saved, up, grads)
    for array, grad in ((w.wh, grads.wh), (w.b, grads.b)):
        at = (0,) + tuple(0 for _ in array.shape[1:])
        array[at] += 1e-2
        more = (h.forward(w, 0, x @ w.wx[0] + w.b[0], mask) * up).sum()
        array[at] -= 2e-2
        less = (h.forward(w, 0, x @ w.wx[0] + w.b[0], mask) * up).sum()
        array[at] += 1e-2
        assert abs((more - less) / 2e-2 - grad[at]) < 2e-2 * max(1, abs(grad[at]))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav><!-- ad --><div class="ad">Buy this now or never.</div>
<article><h1>A title</h1><p>First  paragraph &amp; more&nbsp;text
on two lines.</p><p><b>Bold start of a paragraph.<br><p>Another paragraph stands here, with a <a href="x">link</a> in it.</p>
<div class="advert">Sponsored words stand here.</div><p>The last one.</p></article>
<section id="comments"><div class="comment"><p>I liked this very much, thank you.</p></div></section>
<form><label>Your mail</label><input><button>Send</button></form><footer>&copy; example.com</footer></body></html>"""


def test_article_without_the_rest(weights):
    want = "A title\nFirst paragraph & more text on two lines.\nBold start of a paragraph.\nAnother paragraph stands here, with a link in it.\nThe last one."
    assert text_of(PAGE, weights) == want


def test_cut_off_page(weights):
    cut = PAGE[: PAGE.index("stands here, with")] + "stan</artic"
    assert text_of(cut, weights).endswith("Another paragraph stan")


@pytest.mark.parametrize("html", [None, "", " ", "<", "<html>", "<!--", "<script>x", "<p", "</p></p>", "&", "<style>a{}", "<td><tr><li>"])
def test_broken_markup_has_no_text(html, weights):
    assert text_of(html, weights) in ("", "&", "<")


def plain_logits(w, x):
    """One page, one block after the other, by the formulas of the cell."""
    sides = []
    for d, blocks in ((0, x), (1, x[::-1])):
        hidden, cell, out = np.zeros(h.HIDDEN), np.zeros(h.HIDDEN), []
        for v in blocks:
            i, f, o, g = np.split(v @ w.wx[d] + w.b[d] + hidden @ w.wh[d], 4)
            gate = lambda a: 1 / (1 + np.exp(-a))
            cell = gate(f) * cell + gate(i) * np.tanh(g)
            hidden = gate(o) * np.tanh(cell)
            out.append(hidden)
        sides.append(out if d == 0 else out[::-1])
    return np.array([np.r_[a, b] @ w.out + w.bias[0] for a, b in zip(*sides)])


def test_labels_match_a_plain_version(weights, monkeypatch):
    rng, words = np.random.default_rng(31), h.WordRows()
    pages = [p for _ in range(12) if (p := h.leaves(sample_page(rng)[0]))]
    want = [plain_logits(weights, h.inputs(p, words)) for p in pages]
    for size in (h.AT_ONCE, 7):  # in pieces, too
        monkeypatch.setattr(h, "AT_ONCE", size)
        for a, b in zip(h.logits(weights, pages, words), want):
            assert np.allclose(a, b, atol=1e-3)


def plain_paths(html):
    """The blocks of a page without sloppy markup, with the names and label words of their open elements."""
    from html.parser import HTMLParser

    found = []

    class Reader(HTMLParser):
        open_, text = [], []

        def flush(self):
            if joined := " ".join("".join(self.text).split()):
                found.append((joined, [n for n, _ in self.open_], {w for _, ws in self.open_ for w in ws}))
            self.text = []

        def handle_starttag(self, tag, attrs):
            if tag in h.BLOCK:
                self.flush()
                self.open_ = [*self.open_, (tag, [x.lower() for k, v in attrs if k in ("class", "id", "role") for x in h.PART.findall(v)])]

        def handle_endtag(self, tag):
            if tag in h.BLOCK:
                self.flush()
                self.open_ = self.open_[:-1]

        def handle_data(self, data):
            self.text = [*self.text, data]

    Reader().feed(html)
    return found


def test_paths_match_a_plain_version():
    html = "<body><div class='main wideCol a b c d e f g h i'><h1 id=top>A</h1><section><p>one <b>two</b></p><ul><li>x</li><li>y</li></ul></section></div><p>last</p></body>"
    got = h.leaves(html)
    want = plain_paths(html)
    assert [x.text for x in got] == [t for t, _, _ in want]
    for leaf, (_, names, words) in zip(got, want):
        names = [n for n in names if n != "body"]
        bits = h.Bits()
        says = 0
        for part in [*(f"t {n}" for n in names), *(f"w {w}" for w in words), f"e {names[-1]}", "e2 " + " ".join(names[-2:])]:
            says |= bits[part]
        assert (leaf.says, leaf.depth) == (says, len(names))


def test_deep_nesting_takes_little_memory(weights):
    import tracemalloc

    html = "".join(f"<div class='level {k} x{k}'>t{k} " for k in range(20_000))
    tracemalloc.start()
    page = h.leaves(html)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(page) == 20_000 and page[-1].depth == 20_000 and peak < 60e6
    assert len(h.logits(weights, [page], h.WordRows())[0]) == 20_000


def test_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "<p>" * 5000), (3, "w", "<article>" + "<p>Some words of a paragraph.</p>" * 3000 + "</article>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = h.extract(pages).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id is None] == [""]
    assert next(r for r in got if r.page_id == 3).text.count("\n") == 2999
    assert h.extract(pages.limit(0)).count() == 0
