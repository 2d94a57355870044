"""The block labeller: a bidirectional LSTM in numpy over a page's blocks, trained on pages that it makes up.

No table marks blocks as main text, so the training pages come from a generator: layouts of the usual parts (menus,
headers, adverts, notices, sidebars, forms, comments, footers) around an article, with random words, random subsets
of attribute names, missing end tags and parts in any order. Its sizes are parameters, it is seeded, and each block's
label is known.
"""

from __future__ import annotations

import random
import zlib
from functools import lru_cache

import numpy as np

from dyadflow.llm.html_blocks import Block, Node, blocks_of

TAG_SLOTS, PATH_SLOTS, WORD_SLOTS, PLAIN = 16, 64, 16, 10
WIDTH = TAG_SLOTS + PATH_SLOTS + WORD_SLOTS + PLAIN
HIDDEN, PAGES, EPOCHS, BATCH, SEED = 20, 2400, 6, 32, 5


@lru_cache(maxsize=1 << 16)
def _slot(text: str, slots: int) -> int:
    """A slot and a sign, by hash: slot, or slots + slot for a minus."""
    h = zlib.crc32(text.encode())
    return (h >> 8) % slots + (0 if h & 1 else slots)


def _path(node: Node) -> np.ndarray:
    """Signed hashes of the block-level tags and the names around, each once; an element adds its own to its parent's."""
    waiting = []
    while node.vector is None and node.parent:
        waiting.append(node)
        node = node.parent
    if node.vector is None:
        node.vector = np.zeros(PATH_SLOTS, np.float32)
    for x in reversed(waiting):
        x.vector = node.vector
        if x.new:
            x.vector = node.vector.copy()
            for f in x.new:
                for salt in ("", "2 "):
                    k = _slot(salt + f, PATH_SLOTS)
                    x.vector[k % PATH_SLOTS] += 1 if k < PATH_SLOTS else -1
        node = x
    return node.vector


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block: tag-path hashes, hashed words (all of them), and plain numbers."""
    n = len(blocks)
    out = np.zeros((n, WIDTH), np.float32)
    if not n:
        return out
    codes: list[int] = []
    counted, inner = [], []
    for b in blocks:
        text = b.text
        words = text.lower().split(" ")
        codes += [_slot(w, WORD_SLOTS) for w in words]
        inner.append(_slot(f"inner {b.node.inner}", TAG_SLOTS))
        counted.append((len(text), b.linked, len(words), text.count(".") + text.count(","), text[-1] in ".!?…:\"", b.node.depth))
    at, inner = np.arange(n), np.array(inner)
    size, linked, length, marks, ended, depth = np.array(counted).T
    out[at, inner % TAG_SLOTS] = np.where(inner < TAG_SLOTS, 1, -1)
    out[:, TAG_SLOTS : TAG_SLOTS + PATH_SLOTS] = [_path(b.node) for b in blocks]
    both = np.bincount(np.repeat(at, length) * 2 * WORD_SLOTS + np.array(codes), minlength=n * 2 * WORD_SLOTS).reshape(n, 2, WORD_SLOTS)
    out[:, TAG_SLOTS + PATH_SLOTS : -PLAIN] = (both[:, 0] - both[:, 1]) / length[:, None]
    p = out[:, -PLAIN:]
    p[:, 0] = np.log1p(size) / 4
    p[:, 1] = linked / size
    p[:, 2] = np.log1p(length - 1) / 3
    p[:, 3] = np.minimum(1.0, 20 * marks / size)
    p[:, 4] = ended
    p[:, 5] = np.log1p(depth) / 2
    p[:, 6] = at / n
    p[:, 7] = min(1.0, n / 50)
    p[0, 8] = p[-1, 9] = 1
    return out


class Generator:
    """Made-up pages with labels."""

    NAMES = {
        "header": ["header", "masthead", "site-header", "page-header", "topbar", "banner", "branding", "logo", "site-title", "top"],
        "nav": ["nav", "navbar", "menu", "main-menu", "navigation", "breadcrumbs", "breadcrumb", "pagination", "skip-links", "tabs", "toc", "links"],
        "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "ad-slot", "banner-ad", "adsense", "sponsor", "commercial"],
        "notice": ["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "disclaimer", "privacy", "subscribe", "paywall", "message"],
        "sidebar": ["sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "more-stories", "tags", "share", "social", "rail", "secondary"],
        "comments": ["comments", "comment", "comment-list", "comment-body", "responses", "replies", "discussion", "disqus", "reader-comments", "feedback"],
        "footer": ["footer", "site-footer", "page-footer", "copyright", "bottom", "colophon", "legal", "credits"],
        "form": ["form", "search", "search-form", "login", "newsletter", "signup", "contact-form", "newsletter-signup"],
        "article": ["article", "content", "main-content", "post", "entry", "entry-content", "article-body", "post-body", "story", "text", "body", "page-content", "main"],
    }
    TAGS = {"header": ["header", "div"], "nav": ["nav", "div", "ul"], "ad": ["div", "aside", "ins", "section", "p"], "notice": ["div", "aside", "section", "dialog", "p"], "sidebar": ["aside", "div", "section"], "comments": ["section", "div", "ol", "ul"], "footer": ["footer", "div"], "form": ["form"], "article": ["article", "main", "div", "section"]}

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choices("abcdefghijklmnopqrstuvwxyzéüñ", k=1 + self.r.randrange(1, 4))) for _ in range(400)]

    def pick(self, xs):
        return self.r.choice(xs)

    def word(self) -> str:
        return "".join(self.r.choices(self.syllables, k=self.r.randrange(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        out = [self.word() for _ in range(self.r.randrange(lo, hi + 1))]
        style = self.r.random()
        if style < 0.15:  # marks between or after words, any of ASCII's
            mark = self.pick(["&amp;", *"!#$%*+-/:;=?@^_|~"]) * self.r.randrange(1, 4)
            out = [x for w in out for x in (w, mark)] if style < 0.05 else [(w.upper() if style < 0.1 else w) + mark for w in out]
        else:
            out = [w + (self.pick([",", ".", "", "", "", "", "", ""])) for w in out]
        return " ".join(out).capitalize() + (self.pick([".", ".", ".", "", "!"]))

    def attributes(self, kind: str, bare: float) -> str:
        if self.r.random() < bare:
            return ""
        name = self.pick(self.NAMES[kind])
        extra = f" {self.word()}" if self.r.random() < 0.3 else ""
        q = self.pick(['"', '"', "'"])
        return f" {self.pick(['class', 'class', 'class', 'id', 'role'])}={q}{name}{extra}{q}"

    def inline(self, text: str) -> str:
        x = self.r.random()
        if x < 0.1:
            return f"<b>{text}" + ("</b>" if self.r.random() < 0.5 else "<br>")
        if x < 0.25:
            ws = text.split(" ")
            i = self.r.randrange(len(ws))
            ws[i] = f'<a href="/{self.r.randrange(99)}">{ws[i]}</a>' if self.r.random() < 0.6 else f"<em>{ws[i]}</em>"
            return " ".join(ws)
        return text

    def links(self, lo: int, hi: int) -> str:
        n = self.r.randrange(lo, hi + 1)
        item = self.pick(["li", "li", "span", "div", ""])
        out = "".join((f"<{item}>" if item else "") + f'<a href="/{i}">{self.words(1, 3) if self.r.random() < 0.3 else self.word()}</a>' + (f"</{item}>" if item and (item != "li" or self.r.random() < 0.7) else " ") for i in range(n))
        return f"<ul>{out}</ul>" if item == "li" else out

    def paragraphs(self, lo: int, hi: int) -> str:
        out = []
        for _ in range(self.r.randrange(lo, hi + 1)):
            x, size = self.r.random(), (1, 4) if self.r.random() < 0.25 else (5, 60)
            t = self.inline(self.words(*size))
            if x < 0.78:
                out.append(f"<p>{t}" + ("</p>" if self.r.random() < 0.8 else ""))
            elif x < 0.84:
                out.append(f"<h{self.r.randrange(2, 5)}>{self.words(1, 8)}</h2>")
            elif x < 0.89:
                out.append("<ul>" + "".join(f"<li>{self.inline(self.words(2, 15))}</li>" for _ in range(self.r.randrange(1, 6))) + "</ul>")
            elif x < 0.93:
                out.append(f"<blockquote>{t}</blockquote>")
            elif x < 0.96:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(self.r.randrange(1, 4))) + "</table>")
            else:
                out.append(f"<pre>{t}</pre>")
        return "".join(out)

    def part(self, kind: str) -> str:
        tag = self.pick(self.TAGS[kind])
        bare = 0.5 if tag not in ("div", "section", "p", "ul", "ol", "ins") else 0.03
        inside = {
            "header": lambda: f"<h1>{self.words(1, 5)}</h1>" * (self.r.random() < 0.5) + f"<p>{self.words(2, 10)}</p>" * (self.r.random() < 0.5) + self.links(1, 5) * (self.r.random() < 0.5),
            "nav": lambda: self.links(2, 10),
            "ad": lambda: self.words(2, 40) if self.r.random() < 0.6 else f"<p>{self.words(3, 30)}</p><a href='/x'>{self.words(1, 4)}</a>",
            "notice": lambda: f"<noscript>{self.words(3, 20)}</noscript>" if self.r.random() < 0.1 else self.pick(["", "<p>"]) + self.words(5, 40) + self.pick(["", "<button>" + self.word() + "</button>", f"<a href='/p'>{self.word()}</a>"]),
            "sidebar": lambda: f"<h3>{self.words(1, 4)}</h3>" * (self.r.random() < 0.7) + (self.links(2, 8) if self.r.random() < 0.6 else self.paragraphs(1, 3)),
            "comments": lambda: f"<h3>{self.words(1, 3)}</h3>" * (self.r.random() < 0.6) + "".join(f"<{t}{self.attributes('comments', 0.3)}><p>{self.words(3, 40)}</p></{t}>" for t in [self.pick(["div", "li", "article"])] for _ in range(self.r.randrange(1, 5))),
            "footer": lambda: f"&copy; {self.words(2, 20)}" if self.r.random() < 0.5 else f"<p>{self.words(2, 25)}</p>{self.links(1, 5)}",
            "form": lambda: f"<label>{self.words(1, 4)}</label><input name=q>" + f"<p>{self.words(2, 12)}</p>" * (self.r.random() < 0.4) + f"<button>{self.word()}</button>",
        }[kind]()
        return f"<{tag}{self.attributes(kind, bare)}>{inside}</{tag}>"

    def article(self) -> str:
        """The article; its own blocks stand between marks."""
        tag = self.pick(["article", "article", *self.TAGS["article"]])
        bare = 0.6 if tag in ("article", "main") else 0.1
        body = [f"\x01{self.paragraphs(1, 4)}\x02" for _ in range(self.r.randrange(1, 6))]
        for kind, p in (("ad", 0.2), ("sidebar", 0.12), ("form", 0.08), ("notice", 0.08), ("nav", 0.05)):
            if self.r.random() < p:
                body.insert(self.r.randrange(len(body) + 1), self.part(kind))
        title = f"\x01<h1>{self.words(1, 10)}</h1>\x02" if self.r.random() < 0.8 else ""
        if self.r.random() < 0.2:
            title = f"<header>{title}</header>"
        comments = self.part("comments") if self.r.random() < 0.15 else ""
        footer = self.part("footer") if self.r.random() < 0.08 else ""
        return f"<{tag}{self.attributes('article', bare)}>{title}{''.join(body)}{comments}{footer}</{tag}>"

    def page(self) -> tuple[list[Block], np.ndarray]:
        r = self.r.random
        before = [k for k, p in (("header", 0.5), ("nav", 0.8), ("ad", 0.45), ("notice", 0.3), ("form", 0.2), ("sidebar", 0.2)) if r() < p]
        after = [k for k, p in (("ad", 0.2), ("sidebar", 0.4), ("comments", 0.4), ("form", 0.2), ("notice", 0.2), ("nav", 0.15)) if r() < p]
        self.r.shuffle(before)
        self.r.shuffle(after)
        body = "".join(map(self.part, before)) + self.article() + "".join(map(self.part, after)) + (self.part("footer") if r() < 0.8 else "")
        if r() < 0.2:
            body = f"<div class='{self.pick(['wrapper', 'container', 'page', 'layout', self.word()])}'>{body}</div>"
        page = f"<html><head><title>{self.words(1, 8)}</title></head><body>{body}</body></html>"
        labels, texts, inside = [], [], False
        for b in blocks_of(page):
            own = inside
            for c in b.text:
                if c == "\x01":
                    own = inside = True
                elif c == "\x02":
                    inside = False
            b.text = b.text.replace("\x01", "").replace("\x02", "").strip()
            if b.text:
                texts.append(b)
                labels.append(own)
        return texts, np.array(labels, np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BlockLabeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = SEED, hidden: int = HIDDEN):
        r = np.random.default_rng(seed)
        self.h = hidden
        scale = 1 / np.sqrt(WIDTH + hidden)
        self.w = {f"{d}{k}": (r.normal(0, scale, s) if s else np.zeros(4 * hidden)).astype(np.float32) for d in "fb" for k, s in (("x", (WIDTH, 4 * hidden)), ("h", (hidden, 4 * hidden)), ("0", ()))}
        for d in "fb":
            self.w[f"{d}0"][hidden : 2 * hidden] = 1  # remember at first
        self.w |= {"o": r.normal(0, scale, 2 * hidden).astype(np.float32), "s": np.zeros(WIDTH, np.float32), "c": np.zeros(1, np.float32)}

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States in one direction for x (steps, pages, WIDTH); steps that mask says aren't there leave the state as it is."""
        steps, n, _ = x.shape
        h = c = np.zeros((n, self.h), np.float32)
        out = np.zeros((steps, n, self.h), np.float32)
        saved = [None] * steps
        z = x @ self.w[f"{d}x"] + self.w[f"{d}0"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = z[t] + h @ self.w[f"{d}h"]
            k = self.h
            s = _sigmoid(g[:, : 3 * k])
            i, f, o, a = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :], np.tanh(g[:, 3 * k :])
            m = mask[t][:, None]
            new_c = f * c + i * a
            tc = np.tanh(new_c)
            new_h = o * tc
            if keep:
                saved[t] = (h, c, i, f, o, a, tc, m)
            h, c = m * new_h + (1 - m) * h, m * new_c + (1 - m) * c
            out[t] = h
        return out, saved

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, sf = self._pass("f", x, mask, keep)
        b, sb = self._pass("b", x, mask, keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.w["o"] + x @ self.w["s"] + self.w["c"], (both, sf, sb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, (both, sf, sb) = self.logits(x, mask, True)
        dz = ((_sigmoid(z) - y) * mask / mask.sum()).astype(np.float32)
        flat = dz.ravel()
        g = {"o": flat @ both.reshape(len(flat), -1), "s": flat @ x.reshape(len(flat), -1), "c": np.array([dz.sum()])}
        k = self.h
        for d, saved, w in (("f", sf, self.w["o"][:k]), ("b", sb, self.w["o"][k:])):
            steps, n, _ = x.shape
            dg = np.zeros((steps, n, 4 * k), np.float32)
            dh, dc = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
            gh = np.zeros_like(self.w[f"{d}h"])
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, c, i, f, o, a, tc, m = saved[t]
                dh = dh + dz[t][:, None] * w
                own, through = dh * m, dh * (1 - m)
                own_c = dc * m + own * o * (1 - tc * tc)
                dg[t] = np.concatenate([own_c * a * i * (1 - i), own_c * c * f * (1 - f), own * tc * o * (1 - o), own_c * i * (1 - a * a)], axis=1)
                gh += h.T @ dg[t]
                dh = dg[t] @ self.w[f"{d}h"].T + through
                dc = own_c * f + dc * (1 - m)
            g |= {f"{d}x": x.reshape(-1, WIDTH).T @ dg.reshape(-1, 4 * k), f"{d}h": gh, f"{d}0": dg.sum((0, 1))}
        return g

    def label(self, pages: list[np.ndarray], most: int = 8192) -> list[np.ndarray]:
        """A probability for each block of each page; pages of like length share a pass of at most `most` blocks with padding."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= most:
                end += 1
            group = order[at:end]
            x, mask = padded([pages[i] for i in group])
            p = _sigmoid(self.logits(x, mask)[0])
            for j, i in enumerate(group):
                out[i] = p[: len(pages[i]), j]
            at = end
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> BlockLabeller:
    """Adam over made-up pages; the same arguments give the same weights."""
    made = Generator(seed)
    data = [(features(b), y) for b, y in (made.page() for _ in range(pages)) if len(b)]
    data.sort(key=lambda d: len(d[0]))
    batches = [data[i : i + BATCH] for i in range(0, len(data), BATCH)]
    model, r = BlockLabeller(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for _ in range(epochs):
        for j in r.permutation(len(batches)):
            x, mask = padded([p for p, _ in batches[j]])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(batches[j]):
                y[: len(labels), k] = labels
            step += 1
            rate = 0.01 * min(1, step / 20) * (1 - 0.9 * step / (epochs * len(batches)))
            for k, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.w[k] = (model.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model
