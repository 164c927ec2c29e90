"""Page extraction on held-out layouts and embeddings against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from matchloom.llm import collisions, htmltext

# 6: pages


ARTICLE = "<article><h1>A title</h1><p>The area is <math><mi>a</mi></math> squared and long enough to be seen.</p><p>Second part of the article here, with some words.</p>"


def test_unended_controls_lose_nothing():
    got = htmltext.main_texts([f"<html><body><nav><button>Menu</nav>{ARTICLE}<button>Share</article><footer>x</footer></body></html>", f"<html><body>{ARTICLE}<canvas>none</canvas><p>A third part that is quite long too.</p></article></body></html>"])
    assert "The area is a squared" in got[0] and "Second part" in got[0] and "Menu" not in got[0] and "Share" not in got[0]
    assert "The area is a squared" in got[1] and "A third part" in got[1] and "none" not in got[1]


@pytest.mark.parametrize("name", sorted(htmltext.MUTED))
def test_controls_in_short_blocks_lose_nothing_but_their_label(name):
    """In a paragraph, a heading and an item of a few words; the line stays one block."""
    inner = f"<{name}><b>LABEL</b></{name}>"
    page = f"<html><body><nav><a href=/x>Home</a>{inner}</nav><article><h2>Some {inner} heading</h2><p>Press the {inner} key now</p><ul><li>first {inner}item</li><li>second</li></ul><p>And a last paragraph that has some more words in it.</p></article></body></html>"
    assert htmltext.main_texts([page]) == ["Some heading\nPress the key now\nfirst item\nsecond\nAnd a last paragraph that has some more words in it."]


def test_whatever_is_no_block_stays_in_its_line():
    page = (
        "<article><p>Look at <picture><source srcset=a><img src=b></picture> the picture that <my-icon>stands</my-icon> in the line.</p>"
        "<p>The <math><semantics><mrow><mi>x</mi><mo>is</mo></mrow><annotation encoding='application/x-tex'>x</annotation></semantics></math> squared, <svg viewBox='0 0 1 1'/> and <svg><title>no</title><text>no</text></svg> nothing <blink>else</blink> at all.</p>"
        "</article>"
    )
    assert htmltext.main_texts([page]) == ["Look at the picture that stands in the line.\nThe xis squared, and nothing else at all."]


def test_misleading_names_keep_long_text():
    text = "These are the words of a paragraph that goes on for quite a while, as paragraphs of articles do, and that nobody would take for an advert or a menu of any kind."
    for attrs in ('id="related-work"', 'class="story reply"', 'id="more-results"', 'class="legal-basis"'):
        got = htmltext.main_texts([f"<html><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>A title of it</h1><p>{text}</p><section {attrs}><h2>On this</h2><p>{text}</p><p>{text}</p></section><p {attrs}>{text}</p></article><footer>me</footer></body></html>"])
        assert got[0].count(text) == 4, attrs


def plain_blocks(tree: list) -> list[str]:
    """Blocks of a tree of (name, children) and texts: the text between two block borders is one."""
    out, run = [], []

    def end():
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    def walk(children, muted):
        for child in children:
            if isinstance(child, str):
                if not muted:
                    run.append(child)
                continue
            name, inner = child
            if name in htmltext.BLOCKS:
                end()
            walk(inner, muted or name in htmltext.MUTED)
            if name in htmltext.BLOCKS:
                end()

    walk(tree, False)
    end()
    return out


def test_blocks_as_a_plain_reader_sees_them():
    """Random small trees: the same blocks, none lost or cut, before the model chooses."""
    import random

    rng = random.Random(4)

    def inline(depth):
        out = []
        for _ in range(rng.randint(1, 3)):
            if depth and rng.random() < 0.5:
                out.append((rng.choice(["b", "a", "span", "x-y", "picture", "math", "semantics", "label", *sorted(htmltext.MUTED)]), inline(depth - 1)))
            else:
                out.append(rng.choice(["one", " two ", "three\n", "  ", "é"]))
        return out

    def block(depth):
        name = rng.choice(["div", "section", "article", "blockquote", "p", "h2", "pre"])
        inner = inline(2) if name in ("p", "h2") or not depth else [x for _ in range(rng.randint(1, 3)) for x in (inline(2) if rng.random() < 0.4 else [block(depth - 1)])]
        return name, inner

    def shown(children):
        return "".join(c if isinstance(c, str) else f"<{c[0]}>{shown(c[1])}</{c[0]}>" for c in children)

    for _ in range(400):
        tree = [("html", [("body", [block(3) for _ in range(rng.randint(1, 3))])])]
        assert [text for _, text in htmltext.Tree(shown(tree)).blocks] == plain_blocks(tree)


def test_deep_pages():
    text = "The deep text of this article is here, with some more words to make it long enough for all."
    for depth in (10, 3000):
        assert htmltext.main_texts([f"<html><body>{'<div>' * depth}<p>{text}</p>{'</div>' * depth}</body></html>"]) == [text]


def test_main_text_of_a_page():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>'
        '<div class="ad">Buy now!</div><article><h1>A &amp; B</h1><p><b>Bold  text\n here.<br><p>Second&nbsp;one.</p><pre>code</pre></article>'
        '<section id="comments"><h3>Comments</h3><div class="comment"><p>First! What a lovely long text this is, I say.</p></div></section><footer>&copy; me</footer></body></html>'
    )
    assert htmltext.main_texts([page]) == ["A & B\nBold text here.\nSecond one.\ncode"]


def test_held_out_layouts():
    right = total = 0
    for page, labels in htmltext.labelled_pages(150, seed=1234):
        tree = htmltext.Tree(page)
        assert len(tree.names) == len(labels)
        kept = htmltext.marginals(htmltext.Forest([tree]), *htmltext.fitted()) >= 0.5
        right += sum(bool(kept[n]) == bool(labels[n]) for n, _ in tree.blocks)
        total += len(tree.blocks)
    assert right / total > 0.98


def test_messages_are_exact_marginals():
    emission, transition, prior = htmltext.fitted()
    tree = htmltext.Tree("<html><body><div><p>one two three</p><ul><li>x</li></ul></div></body></html>")
    f = htmltext.Forest([tree])
    n = len(tree.names)
    node = sum(e[f.codes[:, k]] for k, e in enumerate(emission))
    weight, on = np.zeros(2**n), np.zeros((2**n, n))
    for s in range(2**n):
        y = [(s >> k) & 1 for k in range(n)]
        w = sum(node[k, y[k]] for k in range(n)) + prior[y[0]]
        w += sum(transition[f.parent_kind[k], y[f.parent[k]], y[k]] for k in range(1, n))
        weight[s], on[s] = w, y
    p = np.exp(weight - weight.max())
    want = (p[:, None] * on).sum(0) / p.sum()
    assert np.allclose(htmltext.marginals(f, emission, transition, prior), want)


@pytest.mark.parametrize("page", [None, "", "plain text", "<p>un<closed", "<script>never ends", "<!-- <p>x</p>", "</div></p>", "<" * 500, '<p class="a>broken', "<div>" * 3000 + "deep" + "</div>" * 3000, "<p>" + "x" * 200_000])
def test_broken_pages(page):
    assert isinstance(htmltext.main_texts([page, "<article><p>fine and good enough text here</p></article>"])[0], str)


def test_pages_frame(spark):
    rows = [(1, "u", None), (2, None, "<article><h1>x</h1><p>Some words that are text.</p></article>"), (2, None, "<article><h1>x</h1><p>Some words that are text.</p></article>"), (None, "u", "")]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")).collect()
    assert sorted(((r.page_id or 0, r.text, r.n_chars) for r in got), key=str) == sorted([(1, "", 0), (2, "x\nSome words that are text.", 27), (2, "x\nSome words that are text.", 27), (0, "", 0)], key=str)
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 2: embeddings


def brute(v: dict[int, list[float]], cosine: float) -> dict[int, tuple[int, int]]:
    ids = sorted(v)
    m = np.array([v[i] for i in ids], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= cosine
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], 1 << 60).min(axis=1))
        if (new == label).all():
            return {i: (int(near[k].sum()), int(label[k])) for k, i in enumerate(ids)}
        label = new


def clustered(n: int = 240, d: int = 24) -> dict[int, list[float]]:
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, d))
    return {k: (centres[k % 30] + (0.12 if k % 30 < 12 else 1.5) * rng.standard_normal(d)).tolist() for k in range(n)}


@pytest.mark.parametrize("tile", [512, 5])
def test_links_as_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(collisions, "TILE", tile)
    v = clustered()
    v |= {1000: v[0], 1001: [2 * x for x in v[0]]}
    want = brute(v, 0.9)
    got = collisions.near_vectors(spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")).collect()
    found, true = sum(r.n_links for r in got), sum(n for n, _ in want.values())
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    assert found >= 0.97 * true
    assert np.mean([r.component_id == want[r.vec_id][1] for r in got]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1e300, 1e-300]), (9, [1.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]), (11, [0.0, 1.0]), (None, [1.0, 0.0])]
    got = collisions.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "5 AS n_links")).collect()
    by = {r.vec_id: r for r in got}
    assert len(got) == 13
    assert all(by[k].n_links == 0 and by[k].component_id == k and by[k].kept for k in (1, 2, 3, 4, 5, 6, 9))
    assert by[7].n_links == by[8].n_links == 1 and by[8].component_id == 7
    assert by[10].n_links == 2 and by[11].component_id == 10
    assert collisions.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_calibration_holds():
    s = collisions.Setting.calibrated(50_000, 0.9)
    rng = np.random.default_rng(0)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((4000, 64))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * o
    together = (np.abs(collisions.places_of(a, s) - collisions.places_of(b, s)) <= s.window) & (collisions.cells_of(a, s) == collisions.cells_of(b, s))
    counts = (np.abs(collisions.places_of(a, s) - collisions.places_of(b, s)) <= s.window).sum(axis=1)
    assert together.any(axis=1).mean() > 0.97 and (counts >= s.needed).mean() > 0.99
