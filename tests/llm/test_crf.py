import itertools
import time

import numpy as np
import pytest

from lodestrata.llm import crf
from lodestrata.llm.htmlblocks import blocks

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy now.</div><article><h1>Title &amp; more</h1><p><b>First   text.<br><p>Second <i>te</i>xt.</p></article><footer>&copy; site</footer>"""


@pytest.fixture(scope="module")
def model():
    return crf.trained(200)


def test_blocks():
    assert [b.text for b in blocks(PAGE)] == ["Menu", "Buy now.", "Title & more", "First text.", "Second text.", "© site"]
    assert blocks(None) == blocks("") == []
    assert [b.text for b in blocks("a < b <p c='>'>d</p></div><!-- x")] == ["a < b", "d"]


def test_main_text(spark, model):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE)]
    got = crf.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert sorted((r.page_id or -1, r.text) for r in got) == [(-1, ""), (1, "Title & more First text. Second text."), (1, "Title & more First text. Second text."), (2, "")]


def test_viterbi_is_the_best_labelling(model):
    found = blocks(PAGE)
    gains = [sum(model.weights.get(f, 0.0) for f in (*b.frame.around(), *crf.text_features(b))) for b in found]

    def score(labels):
        total = sum(g for g, y in zip(gains, labels, strict=True) if y)
        return total + sum(model.moves[crf._kin(found[i - 1], found[i])][labels[i - 1], labels[i]] for i in range(1, len(found)))

    best = max(itertools.product((0, 1), repeat=len(found)), key=score)
    assert np.isclose(score(best), score(model.label(found)))


def test_held_out_pages(model):
    pages = crf.labelled_pages(150, seed=77)
    right = total = 0
    for page, text in pages:
        found, labels = crf.label_blocks(page, text)
        right += sum(a == b for a, b in zip(labels, model.label(found), strict=True))
        total += len(labels)
    assert right / total > 0.95


def test_slopes_against_brute_force():
    chains = crf.Chains([crf.label_blocks(*p) for p in crf.labelled_pages(4, seed=5)])
    short = crf.label_blocks(PAGE, "Title & more First text. Second text.")
    chains = crf.Chains([(short[0][:4], short[1][:4]), (short[0][2:5], short[1][2:5])])
    rng = np.random.default_rng(1)
    w, moves = rng.normal(size=len(chains.names)), rng.normal(size=(2, 2, 2))

    def loss(w, moves):
        total = 0.0
        for i in range(chains.n):
            size = int(chains.alive[i].sum())
            gains = [w[chains.column[chains.row == i * chains.longest + t]].sum() for t in range(size)]
            scores = {y: sum(g for g, one in zip(gains, y) if one) + sum(moves[chains.kin[i, t], y[t - 1], y[t]] for t in range(1, size)) for y in itertools.product((0, 1), repeat=size)}
            total += np.log(sum(np.exp(v) for v in scores.values())) - scores[tuple(chains.gold[i, :size])]
        return total / chains.n

    value, slope_w, slope_m = chains.slopes(w, moves)
    assert np.isclose(value, loss(w, moves))
    for k in range(len(w)):
        up, down = w.copy(), w.copy()
        up[k], down[k] = up[k] + 1e-5, down[k] - 1e-5
        assert np.isclose((loss(up, moves) - loss(down, moves)) / 2e-5, slope_w[k], atol=1e-7)
    for k in itertools.product((0, 1), repeat=3):
        up, down = moves.copy(), moves.copy()
        up[k], down[k] = up[k] + 1e-5, down[k] - 1e-5
        assert np.isclose((loss(w, up) - loss(w, down)) / 2e-5, slope_m[k], atol=1e-7)


@pytest.mark.parametrize(
    "unit",
    ["<a x=", '<a "', "<div>", "</p>", '<a ">" ', "<a '>", "<!--", "<script></script ", "<", "<li><ul>", "<td>", "</x", '<p class="', "&amp", "<dl><dt>"],
)
def test_long_broken_and_deep_pages_are_linear(model, unit):
    page = "<p>Head.</p>" + unit * (1_000_000 // len(unit)) + "<p>tail"
    began = time.perf_counter()
    crf.main_text(page, model)
    assert time.perf_counter() - began < 12


def test_what_is_never_closed():
    assert [b.text for b in blocks("<p>a</p><div><svg><g>x</div><p>b</p><template>c")] == ["a", "b"]
    assert [b.text for b in blocks("<p>a <math><mi>x</mi> = 1</math> b</p><script>var t = 1;<p>c")] == ["a x = 1 b"]
    assert [b.text for b in blocks("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>f<p class='x")] == ["a", "b", "c", "d", "e", "f"]


def test_empty_table_and_clashing_names(spark, model):
    df = spark.createDataFrame([(1, "u", PAGE, "t", 0)], "page_id long, url string, html string, text string, _html int")
    assert [r.text for r in crf.extract(df, model).collect()] == ["Title & more First text. Second text."]
    assert crf.extract(df.where("false"), model).collect() == []


def test_the_fit_does_not_depend_on_the_run():
    a, b = crf.trained(40), crf.trained(40)
    assert a.weights == b.weights and (a.moves == b.moves).all()
    assert not any(isinstance(x, (set, frozenset)) for x in a.weights)
