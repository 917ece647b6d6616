"""Main-text extraction with a linear-chain conditional random field over a page's blocks.

Two labels, text and other. A block's features are the tags and the words in the names of
all its ancestors, its own tag and what its text is like; the weight of a change of label
depends on whether two blocks share their parent. Training maximises the likelihood of
labelled pages with forward-backward; decoding is Viterbi.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.htmlblocks import Block, Frame, blocks

#: Labelled pages that are fitted on (made by ``labelled_pages``).
TRAINING_PAGES = 600
#: How a notice of rights opens (fixed values).
_RIGHTS = ("©", "copyright", "(c)")


def text_features(block: Block) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    density = block.link_chars / len(text)
    out = [
        f"own:{block.frame.tag}",
        "links:" + ("none" if density == 0 else "few" if density < 0.3 else "many" if density < 0.8 else "all"),
        "words:" + ("1" if words < 3 else "3" if words < 6 else "6" if words < 11 else "11" if words < 26 else "26"),
        "stop" if text[-1] in ".!?\"”»" else "open",
        "constant",
    ]
    if text[:9].lower().startswith(_RIGHTS):
        out.append("rights")
    return out


def score_of(frame: Frame, weights: dict[str, float]) -> float:
    """The weights of the features of an element and of all around it; each element is summed once."""
    path = []
    while frame is not None and frame.score is None:
        path.append(frame)
        frame = frame.parent
    total = frame.score if frame is not None else 0.0
    for one in reversed(path):
        total += sum(weights.get(f, 0.0) for f in one.features)
        one.score = total
    return total


@dataclass
class Model:
    """Weight of each feature for label text (against other), and of label pairs by kinship."""

    weights: dict[str, float]
    moves: np.ndarray  # [kin, from, to]

    def label(self, found: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        get, moves = self.weights.get, self.moves.tolist()
        a, b, back, parent = 0.0, 0.0, [], None
        for i, block in enumerate(found):
            gain = score_of(block.frame, self.weights) + sum(get(f, 0.0) for f in text_features(block))
            if i:
                (aa, ab), (ba, bb) = moves[_kin(found[i - 1], block)]
                to_a = (a + aa, 0) if a + aa >= b + ba else (b + ba, 1)
                to_b = (a + ab, 0) if a + ab > b + bb else (b + bb, 1)
                back.append((to_a[1], to_b[1]))
                a, b = to_a[0], to_b[0] + gain
            else:
                a, b = 0.0, gain
        if not found:
            return []
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def _kin(before: Block, block: Block) -> int:
    """1 if both blocks stand in the same element or in two with one parent, else 0."""
    return int(before.frame.parent is block.frame.parent)


class Chains:
    """Labelled pages as padded arrays, and the likelihood of their labels with its slopes."""

    def __init__(self, pages: list[tuple[list[Block], list[int]]]):
        pages = [p for p in pages if p[0]]
        self.names: dict[str, int] = {}
        self.longest, self.n = max(len(b) for b, _ in pages), len(pages)
        row, column = [], []
        shape = (self.n, self.longest)
        self.gold, self.kin = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64)
        self.alive = np.zeros(shape, dtype=bool)
        for i, (found, labels) in enumerate(pages):
            for t, block in enumerate(found):
                for f in (*block.frame.around(), *text_features(block)):
                    column.append(self.names.setdefault(f, len(self.names)))
                    row.append(i * self.longest + t)
                self.gold[i, t], self.alive[i, t] = labels[t], True
                if t:
                    self.kin[i, t] = _kin(found[t - 1], block)
        self.row, self.column = np.array(row), np.array(column)

    def slopes(self, w: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log-likelihood of a page's labels and its derivatives, by forward-backward."""
        n, longest, kin, alive, gold = self.n, self.longest, self.kin, self.alive, self.gold
        gain = np.bincount(self.row, w[self.column], n * longest).reshape(n, longest)
        score = np.stack([np.zeros_like(gain), gain], axis=2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = forward[:, t - 1, :, None] + moves[kin[:, t]] + score[:, t, None, :]
            forward[:, t] = np.where(alive[:, t, None], np.logaddexp(step[:, 0], step[:, 1]), forward[:, t - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            step = moves[kin[:, t + 1]] + score[:, t + 1, None, :] + backward[:, t + 1, None, :]
            backward[:, t] = np.where(alive[:, t + 1, None], np.logaddexp(step[:, :, 0], step[:, :, 1]), 0.0)
        p = np.exp(forward + backward - total[:, None, None])[:, :, 1]
        miss = np.where(alive, p - gold, 0.0) / n
        slope_m, every = np.zeros_like(moves), np.arange(n)
        told = np.where(alive, gain * gold, 0.0).sum(axis=1)
        for t in range(1, longest):
            pair = np.exp(forward[:, t - 1, :, None] + moves[kin[:, t]] + score[:, t, None, :] + backward[:, t, None, :] - total[:, None, None])
            pair[every, gold[:, t - 1], gold[:, t]] -= 1
            np.add.at(slope_m, kin[:, t], np.where(alive[:, t, None, None], pair, 0.0) / n)
            told += np.where(alive[:, t], moves[kin[:, t], gold[:, t - 1], gold[:, t]], 0.0)
        return float((total - told).mean()), np.bincount(self.column, miss.ravel()[self.row], len(w)), slope_m


def fit(pages: list[tuple[list[Block], list[int]]], steps: int = 300, l2: float = 1e-5) -> Model:
    """Fit on pages of blocks with labels (1: main text). All pages take each step together."""
    chains = Chains(pages)
    w, moves = np.zeros(len(chains.names)), np.zeros((2, 2, 2))
    grown_w, grown_m = np.full(w.shape, 1e-8), np.full(moves.shape, 1e-8)
    for _ in range(steps):
        _, slope_w, slope_m = chains.slopes(w, moves)
        for target, slope, sums in ((w, slope_w + l2 * w, grown_w), (moves, slope_m + l2 * moves, grown_m)):
            sums += slope**2
            target -= 0.5 * slope / np.sqrt(sums)
    return Model({f: float(w[i]) for f, i in chains.names.items()}, moves)


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 11) -> list[tuple[str, str]]:
    """Pages and their main text, built from the usual ways to mark up the parts of a page.

    Words are invented, so only structure, names and the shape of a text can be learnt.
    """
    rng = random.Random(seed)
    # names by which pages commonly mark their parts (fixed values)
    other = {
        "nav": ["", "nav", "navbar", "main-menu", "menu", "breadcrumb", "breadcrumbs", "pagination", "toc", "tabs", "topnav"],
        "header": ["", "header", "site-header", "masthead", "top-bar", "page-header", "banner", "logo"],
        "footer": ["", "footer", "site-footer", "page-footer", "copyright", "colophon", "legal"],
        "aside": ["", "sidebar", "widget", "related", "related-posts", "recommended", "right-rail", "popular", "trending", "side"],
        "div.ad": ["ad", "ads", "advert", "advertisement", "ad-banner", "sponsored", "promo", "sponsor", "google-ads", "adsbox"],
        "div.notice": ["cookie-notice", "cookie", "cookie-banner", "consent", "notice", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe", "paywall", "disclaimer", "announcement"],
        "form": ["", "search", "login", "signup", "newsletter-form", "contact", "comment-form"],
        "div.social": ["share", "social", "share-buttons", "follow", "social-links", "tags", "meta", "byline", "author-bio", "print"],
        "section.comments": ["comments", "comment", "comment-list", "reader-comments", "user-comments", "responses", "discussion", "disqus", "comments-area", "replies"],
    }
    body = ["article", "main", "div.content", "div#content", "div.article-body", "div.post", "div.entry-content", "section.story", "div#main", "div.post-content", "main article", "div.text", "section", "div.page article", "article.post div.body"]
    letters = "abcdefghilmnoprstuvé"

    def word() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))

    def sentence(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + rng.choice([".", ".", ".", "!", "?"])

    def prose() -> str:
        return " ".join(sentence(1, 16) for _ in range(rng.choice([1, 1, 2, 4, 7])))

    def links(count: int) -> str:
        kind = rng.choice(["ul", "ul", "ol", "div", "p"])
        made = [f'<a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 3)))}</a>' for _ in range(count)]
        return f"<{kind}>{''.join(f'<li>{x}</li>' for x in made)}</{kind}>" if kind in ("ul", "ol") else f"<{kind}>{rng.choice([' | ', ' '])}".join(made) if kind == "p" else "<div>" + " ".join(made) + "</div>"

    def dress(spec: str, inner: str) -> str:
        for one in reversed(spec.split()):
            tag, mark, name = one.partition("#") if "#" in one else one.partition(".")
            attribute = f' {"id" if mark == "#" else "class"}="{name}"' if name else ""
            inner = f"<{tag}{attribute}>{inner}</{tag}>"
        return inner

    def noise(kind: str) -> str:
        name = rng.choice(other[kind])
        tag = kind.partition(".")[0] if rng.random() < 0.7 and (not name or kind in ("nav", "header", "footer", "aside", "form", "section.comments")) else "div"
        if tag == "div" and not name:
            tag = kind.partition(".")[0]
        tag = rng.choice([tag, tag, tag, "section", "aside", "p"]) if name and tag == "div" else tag
        if kind in ("nav", "div.social"):
            inner = links(rng.randint(1, 7)) if rng.random() < 0.7 else sentence(1, 6)
        elif kind == "section.comments":
            inner = ("<h3>" + sentence(1, 3) + "</h3>") * rng.randint(0, 1) + "".join(f"<{t}>{prose()}</{t}>" for t in [rng.choice(["p", "li", "div"])] * rng.randint(1, 4))
        elif kind == "form":
            inner = f"<label>{sentence(1, 4)}</label><input name=q><button>{word()}</button>" + ("<p>" + sentence(3, 9) + "</p>") * rng.randint(0, 1)
        elif kind == "footer":
            inner = rng.choice(["&copy; ", "Copyright ", ""]) + prose() + rng.choice(["", links(3)])
        elif kind == "header":
            inner = rng.choice([f"<h2>{sentence(1, 5)}</h2>", links(3), sentence(1, 8), f"<p>{sentence(2, 8)}</p>"])
        else:
            inner = rng.choice([prose(), f"<p>{prose()}</p>", f"<h3>{sentence(1, 4)}</h3><p>{prose()}</p>", links(rng.randint(1, 5)), f"<h4>{sentence(1, 3)}</h4>" + links(3)])
        ident = rng.choice(["class", "class", "id"])
        marked = f' {ident}="{name}"' if name else ""
        if kind == "nav" and not name and rng.random() < 0.2:
            marked = ' role="navigation"'
        return f"<{tag}{marked}>{inner}</{tag}>"

    out = []
    for _ in range(n):
        text, inner = [], []

        def say(x: str) -> str:
            text.append(x)
            return x.replace("&", "&amp;")

        for k in range(rng.randint(1, 9)):
            part = rng.random()
            if k == 0 and rng.random() < 0.8:
                inner.append(f"<h1>{say(' '.join(word() for _ in range(rng.randint(1, 9))))}</h1>")
            elif part < 0.62:
                close = "</p>" if rng.random() < 0.8 else ""
                lead = "<b>" if rng.random() < 0.2 else ""
                inner.append(f"<p>{lead}{say(prose())}{close}" + ("<br>" if lead else ""))
            elif part < 0.7:
                inner.append(f"<h{rng.choice('23')}>{say(sentence(1, 6)[:-1])}</h2>")
            elif part < 0.77:
                inner.append("<ul>" + "".join(f"<li>{say(sentence(2, 12))}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif part < 0.82:
                inner.append(f"<blockquote>{say(prose())}</blockquote>")
            elif part < 0.86:
                inner.append("<table>" + "".join(f"<tr><td>{say(word())}</td><td>{say(word())}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>")
            elif part < 0.9:
                inner.append(f"<div>{say(prose())}</div>")
            else:
                inner.append(noise(rng.choice(["div.ad", "div.social", "aside", "div.notice", "form", "nav"])))
        if rng.random() < 0.25:
            inner.append(noise("section.comments"))
        if rng.random() < 0.1:
            inner.append(noise("footer"))
        before = [noise(k) for k in ("header", "nav", "div.notice", "div.ad", "aside", "form") if rng.random() < 0.45]
        after = [noise(k) for k in ("section.comments", "aside", "div.ad", "div.social", "form", "nav", "div.notice") if rng.random() < 0.3]
        rng.shuffle(before)
        after += [noise("footer")] * (rng.random() < 0.8)
        shell = rng.choice(["", "", "", "div.wrapper", "div.container", "div#page"])
        page = "".join(before) + dress(rng.choice(body), "".join(inner)) + "".join(after)
        out.append((f"<html><head><title>{word()}</title></head><body>{dress(shell, page) if shell else page}</body></html>", " ".join(text)))
    return out


def label_blocks(page: str, text: str) -> tuple[list[Block], list[int]]:
    """Blocks of a labelled page; those are main text that follow each other in its text."""
    found, labels, at = blocks(page), [], 0
    for block in found:
        hit = text.startswith(block.text, at)
        labels.append(int(hit))
        if hit:
            at = min(len(text), at + len(block.text) + 1)
    return found, labels


def trained(n: int = TRAINING_PAGES, seed: int = 11) -> Model:
    return fit([label_blocks(page, text) for page, text in labelled_pages(n, seed)])


def main_text(page: str | None, model: Model) -> str:
    found = blocks(page)
    return " ".join(b.text for b, keep in zip(found, model.label(found), strict=True) if keep)


def extract(pages: DataFrame, model: Model, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """One row per row of ``pages``: the key columns and text, the page's main text.

    Null or empty pages, and pages without main text, give an empty text. Repeated rows are
    each extracted; null keys stay null; other columns are ignored, whatever their names; no
    rows give no rows. Very long, broken or deeply nested pages are read whole in linear time. Of
    labellings that score alike the one is taken that leaves a block out.
    """
    rows = pages.select(*[F.col(k) for k in keys], F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            texts = pa.array([main_text(x.as_py(), model) for x in got.column(len(keys))], pa.string())
            yield pa.RecordBatch.from_arrays([*(got.column(i) for i in range(len(keys))), texts], [*keys, "text"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "text string"]))
