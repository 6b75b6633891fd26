"""Main-text extraction with a recurrent block labeller.

A bidirectional LSTM in numpy reads the leaf blocks of a page in order. Each
block is a bag of its hashed path (element names and the words of ``class``,
``id`` and ``role``), a bag of all its hashed words, and a few measures (length,
share of link text, place in the page, punctuation); the two passes give every
block the context of the whole page before and after it, and a logistic layer
labels it as main text or not.

The labeller is trained here: on pages composed at random with known labels
(many ways to mark up navigation, headers, footers, sidebars, notices, adverts,
forms and comments around an article), and on at most ``FIT_PAGES`` of the
pages at hand whose own sectioning elements give the labels away, of at most
``FIT_BLOCKS`` blocks and about ``FIT_CHARS`` characters together. The fit is one task of an executor; long pages
are learnt from in stretches of ``STRETCH`` blocks, and labelled whole.

Inputs are sparse: the product with the input weights adds up rows of the
weights, so a block costs its words and names and not the width of the layer.

Defined cases: null or empty html gives the empty text; pages without main text
give the empty text; repeated rows give equal texts.
"""

from __future__ import annotations

import math
import random
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fit_in_task, one_blas_thread, sample_rows, text_slices, texts_of
from .html_blocks import PATH_BITS, Block, Path, leaf_blocks
from .html_blocks import slot as _slot
from .ngrams import SparseRows

WORD_BITS, MEASURES = 6, 8
WIDTH = (1 << PATH_BITS) + (1 << WORD_BITS) + MEASURES
HIDDEN = 16
FIT_PAGES = 256
FIT_BLOCKS = 100_000
#: No further page joins the fitting sample once it has so many characters.
FIT_CHARS = 64 << 20
STRETCH = 512
#: Input entries that are multiplied at once.
STEP_ENTRIES = 1 << 16
COMPOSED_PAGES = 900
EPOCHS = 8

def block_rows(blocks: list[Block]) -> SparseRows:
    """One sparse row per block; entries of one feature add up."""
    words_at = 1 << PATH_BITS
    measures_at = words_at + (1 << WORD_BITS)
    seen_path: dict[Path, list[int]] = {}
    features, values, sizes = array("i"), array("f"), array("q")
    for k, b in enumerate(blocks):
        held = seen_path.get(b.path)
        if held is None:
            path = b.path if isinstance(b.path, Path) else Path.of(b.path)
            held = seen_path[b.path] = sorted(path.slots | ({_slot("in " + path.last, PATH_BITS)} if path.slots else set()))
        words, n = b.text.lower().split(), len(b.text)
        weight = 1 / math.sqrt(len(words))
        features.extend(held)
        values.extend([1.0] * len(held))
        features.extend([words_at + _slot(w, WORD_BITS) for w in words])
        values.extend([weight] * len(words))
        features.extend(range(measures_at, measures_at + MEASURES))
        values.extend((
            math.log1p(n) / 6, b.link_share, k / len(blocks), (len(blocks) - k) / len(blocks),
            math.log1p(len(words)) / 5, float(b.text[-1] in ".!?…"), min(1.0, b.text.count("|") / 4), float("©" in b.text),
        ))
        sizes.append(len(held) + len(words) + MEASURES)
    offsets = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))]).astype(np.int64)
    return SparseRows(offsets, np.array(features, dtype=np.int32), np.array(values, dtype=np.float32))


def block_features(blocks: list[Block]) -> np.ndarray:
    """The same as a dense matrix: to look at, not to compute with."""
    return block_rows(blocks).dense(WIDTH)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights: per direction (input, recurrent, bias), then the output layer."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = (rng.standard_normal((WIDTH, 4 * HIDDEN)) * 0.1).astype(np.float32)
            w[f"h{d}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            w[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        w["out"] = (rng.standard_normal(2 * HIDDEN + WIDTH) * 0.1).astype(np.float32)
        w["bias"] = np.zeros(1, np.float32)
        return Labeller(w)

    def _inputs(self, x: SparseRows) -> np.ndarray:
        """For each block its input to the gates of both directions and to the output: rows of the weights, added up."""
        weights = np.concatenate([self.weights["xf"], self.weights["xb"], self.weights["out"][2 * HIDDEN :, None]], axis=1)
        out = np.empty((len(x), weights.shape[1]), np.float32)
        a = 0
        while a < len(x):  # about STEP_ENTRIES entries at once
            b = max(a + 1, int(np.searchsorted(x.offsets, x.offsets[a] + STEP_ENTRIES, side="right")) - 1)
            out[a:b] = x.take(np.arange(a, b)).times(weights)
            a = b
        return out

    def _pass(self, z: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states over time (axis 1) from gate inputs; padding leaves the state as it is."""
        n, steps, _ = z.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, steps, HIDDEN), np.float32)
        recurrent, bias = self.weights[f"h{d}"], self.weights[f"c{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = z[:, t] + bias + h @ recurrent
            gates = _sigmoid(g[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            c_new = f * c + i * u
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, u, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
            out[:, t] = h
        return out

    def _forward(self, x: SparseRows | np.ndarray, mask: np.ndarray, keep: dict[str, list] | None = None) -> tuple[SparseRows, list[np.ndarray], np.ndarray]:
        """The input rows, hidden states of both directions, and the probability of each place; ``x`` has a row for each place that ``mask`` has, or is dense."""
        if isinstance(x, np.ndarray):
            x = SparseRows.of(x[mask])
        z = np.zeros((*mask.shape, 8 * HIDDEN + 1), np.float32)
        z[mask] = self._inputs(x)
        hidden = [self._pass(z[:, :, k * 4 * HIDDEN : (k + 1) * 4 * HIDDEN], mask, d, None if keep is None else keep[d]) for k, d in enumerate("fb")]
        out = self.weights["out"]
        return x, hidden, _sigmoid(hidden[0] @ out[:HIDDEN] + hidden[1] @ out[HIDDEN : 2 * HIDDEN] + z[:, :, -1] + self.weights["bias"])

    def probabilities(self, x: SparseRows | np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self._forward(x, mask)[2]

    def gradients(self, x: SparseRows | np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept = {"f": [], "b": []}
        x, hidden, p = self._forward(x, mask, kept)
        e = ((p - y) * mask / max(1, mask.sum())).astype(np.float32)
        by_feature = np.argsort(x.features, kind="stable")
        present, starts = np.unique(x.features[by_feature], return_index=True)
        owner, values = x.owner()[by_feature], x.values[by_feature]

        def of_inputs(per_block: np.ndarray) -> np.ndarray:
            """The product of the transposed input rows with rows per block."""
            out = np.zeros((WIDTH, per_block.shape[1]), np.float32)
            if len(present):
                out[present] = np.add.reduceat(values[:, None] * per_block[owner], starts, axis=0)
            return out

        g = {"out": np.concatenate([np.einsum("nt,ntk->k", e, h) for h in hidden] + [of_inputs(e[mask][:, None])[:, 0]]), "bias": np.array([e.sum()], np.float32)}
        for k, d in enumerate("fb"):
            dh_out = e[:, :, None] * self.weights["out"][k * HIDDEN : (k + 1) * HIDDEN]
            dz = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            recurrent = np.zeros_like(self.weights[f"h{d}"])
            dh, dc = np.zeros((len(mask), HIDDEN), np.float32), np.zeros((len(mask), HIDDEN), np.float32)
            for t, h, c, i, f, o, u, tc, m in reversed(kept[d]):
                dh = dh + dh_out[:, t]
                live, dc_t = np.where(m, dh, 0), np.where(m, dc, 0)
                dc_t = dc_t + live * o * (1 - tc * tc)
                step = np.concatenate([dc_t * u * i * (1 - i), dc_t * c * f * (1 - f), live * tc * o * (1 - o), dc_t * i * (1 - u * u)], axis=1)
                dz[:, t] = step
                recurrent += h.T @ step
                dh = np.where(m, step @ self.weights[f"h{d}"].T, dh)
                dc = np.where(m, dc_t * f, dc)
            g |= {f"x{d}": of_inputs(dz[mask]), f"h{d}": recurrent, f"c{d}": dz.reshape(-1, 4 * HIDDEN).sum(axis=0)}
        return g

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of about equal length share a step."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            longest = len(pages[order[min(at + 63, len(order) - 1)]])
            some = order[at : at + max(1, min(64, 8192 // longest))]
            at += len(some)
            x, mask = padded([block_rows(pages[k]) for k in some])
            p = self.probabilities(x, mask)
            for k, row in zip(some, p, strict=True):
                out[k] = row[: len(pages[k])] >= 0.5
        return out


def padded(rows: list[SparseRows]) -> tuple[SparseRows, np.ndarray]:
    """The rows of several pages one after another, and which places of the padded grid they take."""
    mask = np.arange(max(map(len, rows))) < np.array([len(r) for r in rows])[:, None]
    starts = np.cumsum([0, *(len(r.values) for r in rows)])
    offsets = np.concatenate([[0], *(r.offsets[1:] + a for r, a in zip(rows, starts, strict=False))])
    return SparseRows(offsets, np.concatenate([r.features for r in rows]), np.concatenate([r.values for r in rows])), mask


def train(pages: list[tuple[list[Block], np.ndarray]], epochs: int = EPOCHS, batch: int = 24, rate: float = 0.01, seed: int = 9) -> Labeller:
    """Adam on the mean logistic loss of blocks; pages are cut into stretches of ``STRETCH`` blocks."""
    model = Labeller.fresh()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    rng = np.random.default_rng(seed)
    data = []
    for blocks, y in pages:
        rows = block_rows(blocks) if blocks else None
        for a in range(0, len(blocks), STRETCH):
            data.append((rows.take(np.arange(a, min(a + STRETCH, len(blocks)))), y[a : a + STRETCH].astype(np.float32)))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        # pages of similar length together, the groups in random order
        groups = [order[a : a + 8 * batch] for a in range(0, len(order), 8 * batch)]
        groups = [sorted(g, key=lambda k: len(data[k][0])) for g in groups]
        for g in [g[a : a + batch] for g in groups for a in range(0, len(g), batch)]:
            x, mask = padded([data[k][0] for k in g])
            y = np.zeros(mask.shape, np.float32)
            for k, n in enumerate(g):
                y[k, : len(data[n][1])] = data[n][1]
            step += 1
            lr = rate * min(1, step / 20) * (1 - epoch / (epochs + 1))
            for name, grad in model.gradients(x, mask, y).items():
                a, b = moments[name]
                a += 0.1 * (grad - a)
                b += 0.01 * (grad * grad - b)
                model.weights[name] -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


# ---------------------------------------------------------------- training pages


_SYLLABLES = "the an er on re in ti es ou at en de le ion che ver ung sch que los ción zu ing ble".split()


class _Composer:
    """Pages at random; text with the mark \\x02 in front is main text."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def pick(self, *of):
        return self.rng.choice(of)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randrange(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randrange(low, high)))

    def sentence(self) -> str:
        return self.words(3, 16).capitalize() + "."

    def prose(self) -> str:
        if self.chance(0.04):  # one word again and again
            return " ".join([self.word().capitalize()] * self.rng.randrange(5, 300))
        return " ".join(self.sentence() for _ in range(self.rng.randrange(1, 7))) if self.chance(0.85) else self.pick(self.words(1, 4).capitalize() + ".", " | ".join(self.word() for _ in range(12)), self.words(5, 60).upper() + "!!")

    def links(self, low: int = 3, high: int = 9) -> list[str]:
        named = "Home About Contact News Sport Login Menu Privacy Terms Archive Tags Search Share Next Previous".split()
        return [f'<a href="/{self.word()}">{self.pick(*named) if self.chance(0.5) else self.words(1, 4)}</a>' for _ in range(self.rng.randrange(low, high))]

    def wrap(self, tags: tuple[str, ...], names: tuple[str, ...], body: str, plain: float = 0.5) -> str:
        tag = self.pick(*tags)
        named = tag == "div" or not self.chance(plain)
        attribute = f' {self.pick("class", "class", "id")}="{self.pick(*names)}"' if named and names else ""
        return f"<{tag}{attribute}>{body}</{tag}>"

    def nav(self) -> str:
        inner = self.pick("<ul>" + "".join(f"<li>{x}</li>" for x in self.links()) + "</ul>", " ".join(self.links()), "".join(f"<div>{x}</div>" for x in self.links()))
        return self.wrap(("nav", "nav", "div", "ul"), ("menu", "navbar", "main-nav", "navigation", "breadcrumbs", "topbar", "site-menu"), inner)

    def header(self) -> str:
        inner = self.pick(f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 7)}</p>", f'<a href="/">{self.words(1, 3)}</a>') + (self.nav() if self.chance(0.4) else "") + (f"<p>{self.sentence()}</p>" if self.chance(0.3) else "")
        return self.wrap(("header", "header", "div"), ("header", "masthead", "site-header", "top", "branding"), inner)

    def footer(self) -> str:
        inner = self.pick("&copy; ", "© 2024 ", "Copyright ", "") + self.words(1, 4) + self.pick(" &middot; ", ". ", " | ") + self.pick(self.sentence(), " ".join(self.links(2, 5)), "All rights reserved.")
        return self.wrap(("footer", "footer", "div"), ("footer", "site-footer", "bottom", "copyright", "legal"), self.pick(inner, f"<p>{inner}</p>", f"<p>{inner}</p><p>{self.sentence()}</p>"))

    def aside(self) -> str:
        inner = f"<h3>{self.pick('Related', 'Popular', 'Archive', self.words(1, 3))}</h3>" + self.pick("<ul>" + "".join(f"<li>{x}</li>" for x in self.links()) + "</ul>", f"<p>{self.prose()}</p>", "".join(f"<p>{self.sentence()}</p>" for _ in range(3)))
        return self.wrap(("aside", "aside", "div", "section"), ("sidebar", "widget", "related", "right-rail", "recommended", "side-column"), inner, 0.6)

    def advert(self) -> str:
        inner = self.pick(self.prose(), self.sentence(), "Advertisement", f"<p>{self.prose()}</p>", f"Sponsored <a href='/x'>{self.words(2, 6)}</a>")
        return self.wrap(("div", "div", "aside", "section"), ("ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement"), inner, 0.1)

    def notice(self) -> str:
        inner = self.pick("We use cookies. ", "This site uses cookies to improve your experience. ", "", "Subscribe to our newsletter. ") + self.prose() + self.pick("", " <button>Accept</button>", " <button>OK</button>")
        return self.wrap(("div", "div", "section", "dialog"), ("cookie-notice", "consent", "notice", "popup", "modal", "newsletter", "cookie-banner", "alert"), self.pick(inner, f"<p>{inner}</p>"), 0.05)

    def form(self) -> str:
        inner = self.pick("<label>Email</label><input><button>Send</button>", f"<p>{self.sentence()}</p><input><button>{self.word()}</button>", f"<label>{self.words(1, 3)}</label><select><option>{self.word()}</option><option>{self.word()}</option></select>", "Search <input>")
        return f"<form{self.pick('', ' class=\"search\"', ' id=\"login\"', ' class=\"signup\"')}>{inner}</form>"

    def comments(self) -> str:
        one = lambda: self.pick(f"<p>{self.prose()}</p>", f"<div class='comment'><b>{self.word()}</b><p>{self.prose()}</p></div>", f"<li><cite>{self.word()}</cite> {self.prose()}</li>", f"<article class='comment'><p>{self.prose()}</p></article>")
        inner = self.pick(f"<h3>{self.pick('Comments', 'Discussion', 'Responses', self.words(1, 3))}</h3>", f"<h2>{self.rng.randrange(1, 90)} comments</h2>", "") + "".join(one() for _ in range(self.rng.randrange(1, 6)))
        return self.wrap(("section", "div", "div", "ol"), ("comments", "comment-list", "discussion", "replies", "reader-comments", "disqus"), inner, 0.0)

    def article(self) -> str:
        def paragraph() -> str:
            text = "\x02" + self.prose()
            shape = self.rng.randrange(12)
            if shape == 0:
                return f"<p><b>{text}<br>"
            if shape == 1:
                return f"<h2>\x02{self.words(2, 7)}</h2><p>{text}</p>"
            if shape == 2:
                return "<ul>" + "".join(f"<li>\x02{self.sentence()}</li>" for _ in range(3)) + "</ul>"
            if shape == 3:
                return f"<blockquote><p>{text}</p></blockquote>"
            if shape == 4:
                return f"<p>{text} <a href='/x'>{self.words(1, 4)}</a> {self.sentence()}</p>"
            if shape == 5:
                return f"<table><tr><td>\x02{self.words(1, 4)}</td><td>\x02{self.words(1, 4)}</td></tr></table>"
            return self.pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<div><p>{text}</p></div>")

        if self.chance(0.06):  # many short paragraphs, alike or not
            same = self.words(1, 5).capitalize() + "."
            parts = [f"<p>\x02{same if self.chance(0.5) else self.sentence()}</p>" for _ in range(self.rng.randrange(20, 140))]
        else:
            parts = [paragraph() for _ in range(self.rng.randrange(1, 10))]
        if self.chance(0.8):
            parts.insert(0, f"<h1>\x02{self.words(2, 10)}</h1>")
        for extra, p in ((self.advert, 0.2), (self.aside, 0.08), (self.form, 0.08), (self.nav, 0.05)):
            if self.chance(p):
                parts.insert(self.rng.randrange(1, len(parts) + 1), extra())
        body = "".join(parts)
        tag = self.pick("article", "article", "article", "main", "div", "section")
        names = ("content", "post", "entry-content", "article-body", "story", "post-content", "main-content", "text", "page-content", "body-text")
        out = self.wrap((tag,), names, body)
        return f"<main>{out}</main>" if self.chance(0.25) and tag != "main" else out

    def page(self) -> str:
        before = [f() for f, p in ((self.header, 0.35), (self.nav, 0.7), (self.notice, 0.25), (self.advert, 0.5), (self.form, 0.15), (self.aside, 0.15)) if self.chance(p)]
        after = [f() for f, p in ((self.comments, 0.35), (self.aside, 0.3), (self.advert, 0.25), (self.form, 0.2), (self.notice, 0.2), (self.footer, 0.8)) if self.chance(p)]
        self.rng.shuffle(before)
        body = "".join([*before, self.article(), *after])
        if self.chance(0.3):
            body = f'<div {self.pick("id", "class")}="{self.pick("page", "wrapper", "container", "site")}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{body}</body></html>"


def composed_pages(n: int, seed: int = 1) -> list[tuple[list[Block], np.ndarray]]:
    composer, out = _Composer(seed), []
    for _ in range(n):
        blocks = leaf_blocks(composer.page())
        y = np.array([b.text.startswith("\x02") for b in blocks], dtype=bool)
        out.append(([b._replace(text=" ".join(b.text.replace("\x02", "").split()) or "-") for b in blocks], y))
    return out


def labels_by_markup(blocks: list[Block]) -> np.ndarray | None:
    """Labels where a page's own sectioning elements tell: inside an article or main element and inside nothing that is set apart."""
    y = np.array([b.path.main and not b.path.apart for b in blocks], dtype=bool)
    return y if y.any() else None


def markup_examples(pages: list[str | None], limit: int = FIT_BLOCKS) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks and labels of the pages whose own elements give them away, of ``limit`` blocks in all; the page that reaches the limit is learnt from in part."""
    found = []
    for page in pages:
        blocks = leaf_blocks(page)
        y = labels_by_markup(blocks)
        if y is not None and limit > 0:
            found.append((blocks[:limit], y[:limit]))
            limit -= len(blocks)
    return found


def fit(pages: DataFrame | None = None, composed: int = COMPOSED_PAGES, fit_pages: int = FIT_PAGES) -> Labeller:
    if pages is None:
        with one_blas_thread():
            return train(composed_pages(composed))

    def learn(table: pa.Table) -> Labeller:
        rows = sorted(zip(*(table.column(n).to_pylist() for n in ("page_id", "html")), strict=True), key=lambda r: (str(r[0]), r[1] or ""))
        return train(composed_pages(composed) + markup_examples([r[1] for r in rows]))

    sample = sample_rows(pages.select("page_id", "html"), "page_id", fit_pages)  # a bounded sample for fitting only
    before = Window.orderBy(F.xxhash64("page_id"), "page_id").rowsBetween(Window.unboundedPreceding, -1)  # over the sample's few rows
    return fit_in_task(sample.withColumn("before", F.sum(F.length("html")).over(before)).where(f"before is null or before < {FIT_CHARS}").drop("before"), learn)


def main_text(model: Labeller, pages: list[str | None]) -> list[str]:
    blocks = [leaf_blocks(p) for p in pages]
    return ["\n\n".join(b.text for b, keep in zip(page, label, strict=True) if keep) for page, label in zip(blocks, model.label(blocks), strict=True)]


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text and n_chars for every row."""
    held = pages.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches):
        for batch in batches:
            for a, b in text_slices(batch, "html", 1 << 21):
                texts = main_text(held.value, texts_of(batch, a, b, "html"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
