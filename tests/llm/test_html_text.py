import numpy as np

from snapsift.llm import html_text as h


def texts(page):
    return [b.text for b in h.blocks(page)]


def test_blocks():
    assert texts("") == [] and texts("<p> \n </p>") == [] and texts("a &amp; b&nbsp;c\n d") == ["a & b c d"]
    assert texts("<p>one<b>two</b> <i>three</i><br>four<p>five") == ["onetwo three four", "five"]
    assert texts('<script>var t="</p>";</script><style>p{}</style><!-- x --><title>t</title>y<SCRIPT>z') == ["y"]
    assert texts('<div title="a > b" class=x>in</div>1 < 2 & 3<ul><li>a<li>b</ul>') == ["in", "1 < 2 & 3", "a", "b"]
    assert texts("<p " + '"' * 2001 + ">x" + "<" * 2000)[-1].endswith("<" * 10)
    assert h.blocks('<article class="postBody big"><p>x')[0].path == (("article", ".post", ".body", ".big"), ("p",))


def test_gradients_like_differences():
    rng = np.random.default_rng(0)
    net = h.BlockLabeller(seed=1, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(4, 2, h.FEATURES))
    mask, y = np.array([[1, 1], [1, 1], [1, 1], [1, 0]], float), rng.integers(0, 2, (4, 2)).astype(float)

    def loss():
        z = net.logits(x, mask)
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    for name, grad in net.gradients(x, mask, y).items():
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        before, step = net.p[name][at], 1e-3
        net.p[name][at] = before + step
        up = loss()
        net.p[name][at] = before - step
        down = loss()
        net.p[name][at] = before
        assert abs((up - down) / (2 * step) - grad[at]) < 1e-3


def test_pages_and_foreign_layouts(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    model = h.fit_labeller(pages)
    got = {r.page_id: r.text for r in h.extract_text(pages, model).collect()}
    want = {r.page_id: "\n\n".join(b.text for b in h.blocks(r.html) if h.markup_label(b.path)) for r in pages.collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)
    # The same words in another site's markup.
    rng, right, total = np.random.default_rng(9), 0, 0
    marked = [[(b, h.markup_label(b.path)) for b in h.blocks(r.html)] for r in pages.limit(40).collect()]
    for page in marked:
        new = h.altered(page, [b.text for p in marked for b, _ in p], rng)
        label = model.label([h.vectors([b for b, _ in new])])[0]
        right, total = right + int((label == np.array([g for _, g in new])).sum()), total + len(new)
    assert right / total > 0.9


def test_odd_pages_and_empty_tables(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (None, "u", "<article><p>text</p></article>", "x"), (3, "u", "<p>" * 5000, "x"), (4, "u", "<article><p>" + "w " * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    model = h.fit_labeller(pages)
    out = {r.page_id: r for r in h.extract_text(pages, model).collect()}
    assert out[1].text == out[2].text == out[3].text == "" and out[1].n_chars == 0 and len(out) == 5
    none = h.fit_labeller(pages.limit(0))
    assert {r.text for r in h.extract_text(pages, none).collect()} == {""}
    assert h.extract_text(pages.limit(0), none).count() == 0


def test_drawings_and_formulas():
    assert texts('<svg class="icon"/><article><p>one</p><svg width=1 /><p>two <svg/>three</article>') == ["one", "two three"]
    assert texts("<p>a <svg><title>t</title><desc>d</desc><g><text>label</text><path d=x /></g></svg>b<p>c") == ["a b", "c"]
    assert texts("<p>so <math><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow></math> holds</p>") == ["so x=1 holds"]
    assert texts("<p>a<svg><g></p><p>b</p><div>c<svg><path><div>d</div>") == ["a", "b", "c", "d"]  # never closed
