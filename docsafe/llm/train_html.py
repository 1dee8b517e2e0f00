"""Trains the block labeller on pages of its own making: `python -m docsafe.llm.train_html`.

Pages mix layouts, tag choices, class names, nesting, unclosed tags and invented words, so that only the tag path and
the document around a block tell its label. A fifth of the pages is held out; its accuracy is printed.
"""

from __future__ import annotations

import random

import numpy as np

from docsafe.llm import html_extract as H

SYLLABLES = "an be co da el fi go ha in jo ka li mo ne or pa qui re sa ti un va we xe yo za éa ön ñi st th er ou ing tion".split()
#: (tag, class words) of what is not main text, by kind.
OTHER = {
    "menu": [("nav", ""), ("ul", "menu"), ("div", "navbar"), ("div", "nav main-nav"), ("div", "breadcrumbs"), ("div", "top-menu"), ("nav", "navigation"), ("ol", "breadcrumb"), ("menu", ""), ("div", "pagination")],
    "header": [("header", ""), ("div", "header"), ("div", "site-header masthead"), ("div", "topbar"), ("header", "banner"), ("div", "logo branding")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "site-footer"), ("footer", "copyright"), ("div", "colophon"), ("div", "legal")],
    "sidebar": [("aside", ""), ("div", "sidebar"), ("aside", "related"), ("div", "side-bar widget"), ("section", "related-posts"), ("div", "recommended"), ("div", "widget-area"), ("div", "popular tags"), ("aside", "toc")],
    "notice": [("div", "cookie"), ("div", "cookie-banner notice"), ("div", "notice"), ("section", "alert"), ("div", "consent gdpr"), ("div", "banner message"), ("p", "notice"), ("dialog", ""), ("div", "popup modal"), ("div", "paywall")],
    "advert": [("div", "ad"), ("div", "ads advert"), ("div", "advertisement"), ("aside", "sponsored"), ("div", "promo"), ("section", "ad-slot"), ("p", "ad"), ("div", "adsense"), ("div", "sponsor"), ("ins", "ads")],
    "form": [("form", ""), ("div", "newsletter subscribe"), ("form", "search"), ("form", "login"), ("div", "signup"), ("fieldset", ""), ("section", "contact-form")],
    "comments": [("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "reader-comments"), ("section", "discussion responses"), ("div", "comment"), ("ul", "comments"), ("article", "comment")],
    "share": [("div", "share"), ("ul", "social"), ("div", "share-buttons"), ("div", "author-bio"), ("div", "meta tags")],
}
MAIN = [("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("div", "entry-content"), ("article", "post"), ("section", "story"), ("div", "article-body"), ("div", "main"), ("article", ""), ("article", "article"), ("article", ""), ("section", "content"), ("div", "text body")]
WRAPS = [("div", "wrapper"), ("div", "container"), ("div", "page"), ("section", ""), ("div", ""), ("div", "row"), ("div", "site"), ("div", "layout")]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        out = []
        n = self.r.randint(low, high)
        while len(out) < n:
            k = min(n - len(out), self.r.randint(1, 14))
            s = [self.word() for _ in range(k)]
            out += [s[0].capitalize(), *s[1:]]
            out[-1] += self.r.choice([".", ".", ".", "", ",", "!", "###", "&amp;"])
        return " ".join(out)

    def open(self, kind: tuple[str, str], extra: bool = True) -> str:
        tag, names = kind
        r = self.r
        if not names and extra and r.random() < 0.3:
            names = self.word()
        if not names:
            return f"<{tag}>"
        how = r.random()
        if how < 0.6:
            return f'<{tag} class="{names}">'
        if how < 0.8:
            return f'<{tag} id="{names.split()[0]}">'
        return f'<{tag} id="{self.word()}" class="{self.word()} {names}">'

    def wrap(self, kind: tuple[str, str], inner: str) -> str:
        return self.open(kind) + inner + (f"</{kind[0]}>" if self.r.random() < 0.93 else "")

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(low, high)}</a>'

    def paragraph(self) -> str:
        r = self.r
        text = self.words(1, 6) if r.random() < 0.2 else self.words(4, 90)
        if r.random() < 0.15:
            text = f"<b>{text}" + ("</b>" if r.random() < 0.5 else "<br>")
        elif r.random() < 0.15:
            text += " " + self.link() + " " + self.words(1, 9)
        return f"<p>{text}" + ("</p>" if r.random() < 0.85 else "")

    def aside(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            items = [self.link() for _ in range(r.randint(2, 9))]
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else " | ".join(items)
        elif kind == "footer":
            inner = f"&copy; {self.word()}.example &middot; {self.words(2, 12)}"
            if r.random() < 0.4:
                inner = f"<p>{inner}</p><p>{self.link()} {self.link()}</p>"
        elif kind == "form":
            inner = f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>"
            if r.random() < 0.5:
                inner = f"<p>{self.words(3, 20)}</p>" + inner
        elif kind == "comments":
            inner = f"<h3>{self.words(1, 3)}</h3>" * (r.random() < 0.6) + "".join(r.choice(["<li>{}</li>", '<div class="comment"><p>{}</p></div>', "<p>{}</p>", "<article><p>{}</p></article>"]).format(self.words(3, 60)) for _ in range(r.randint(1, 5)))
        elif kind == "header":
            inner = r.choice([f"<h1>{self.words(1, 4)}</h1>", self.link(), f"<p>{self.words(1, 8)}</p>", f"<div>{self.words(1, 5)}</div>" + self.link()])
        else:
            inner = r.choice([self.words(2, 40), f"<p>{self.words(2, 40)}</p>", f"<h4>{self.words(1, 4)}</h4><ul>" + "".join(f"<li>{self.link(1, 8)}</li>" for _ in range(r.randint(1, 5))) + "</ul>", f"<p>{self.words(4, 50)}</p><p>{self.words(4, 50)}</p>"])
        return f"\x02{self.wrap(r.choice(OTHER[kind]), inner)}\x03"

    def page(self) -> str:
        """HTML with \\x02 and \\x03 around what is not main text, and \\x01 where the main text begins and ends."""
        r = self.r
        body = [f"<h1>{self.words(1, 12)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.8:
                body.append(self.paragraph())
            elif x < 0.86:
                body.append(f"<h{r.randint(2, 4)}>{self.words(1, 8)}</h{r.randint(2, 4)}>")
            elif x < 0.9:
                body.append("<ul>" + "".join(f"<li>{self.words(2, 25)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif x < 0.93:
                body.append(f"<blockquote>{self.words(5, 40)}</blockquote>")
            elif x < 0.95:
                body.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                body.append(self.aside(r.choice(["advert", "notice", "share", "form", "sidebar", "comments"])))
        if r.random() < 0.15:
            body.append(self.aside("comments"))
        main = "\x01" + self.wrap(r.choice(MAIN), "".join(body)) + "\x01"
        before = [self.aside(k) for k in r.sample(["menu", "header", "notice", "advert", "sidebar", "form", "menu"], r.randint(0, 4))]
        after = [self.aside(k) for k in r.sample(["comments", "sidebar", "footer", "advert", "share", "form", "footer", "notice"], r.randint(0, 4))]
        if r.random() < 0.3:
            before.append(f"<!-- {self.words(1, 4)} -->")
        inner = "".join(before) + main + "".join(after)
        while r.random() < 0.35:
            inner = self.wrap(r.choice(WRAPS), inner)
        head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{self.words(1, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>" if r.random() < 0.9 else ""
        return head + inner + ("</body></html>" if r.random() < 0.8 else "")


def labelled(page: str) -> tuple[list, np.ndarray]:
    """Blocks and labels of a marked page; marks stay in the text of blocks only until they are read."""
    marks = "\x01\x02\x03"
    plain = page.translate({ord(c): None for c in marks})
    # a mark is carried into the first text after it by a word of its own
    text, state_of, inside, depth = [], [], False, 0
    for c in page:
        if c == "\x01":
            inside = not inside
        elif c == "\x02":
            depth += 1
        elif c == "\x03":
            depth -= 1
        else:
            text.append(c)
            state_of.append(inside and depth == 0)
    rows = H.blocks(plain)
    # the same cut over text whose letters are replaced by their label
    lettered = H.blocks(_lettered(plain, state_of))
    assert len(rows) == len(lettered)
    return rows, np.array([r[0].count("Y") > r[0].count("N") for r in lettered], np.float32)


def _lettered(plain: str, state: list[bool]) -> str:
    out, at = [], 0
    for m in H.TAG.finditer(plain):
        out += [("Y" if state[i] else "N") if not plain[i].isspace() else plain[i] for i in range(at, m.start())]
        out.append(m[0])
        at = m.end()
    out += [("Y" if state[i] else "N") if not plain[i].isspace() else plain[i] for i in range(at, len(plain))]
    return "".join(out)


def train(pages: int = 2400, epochs: int = 14, seed: int = 7, rate: float = 0.01) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    made = [labelled(Maker(seed * 100_003 + i).page()) for i in range(pages)]
    made = [x for x in made if x[0]]
    cut = len(made) * 4 // 5
    g = 4 * H.HIDDEN
    w = {"paths": rng.normal(0, 0.1, (H.PATHS, 2 * g)), "words": rng.normal(0, 0.1, (H.WORDS, 2 * g)), "counts": rng.normal(0, 0.3, (H.COUNTS, 2 * g)), "bias": np.zeros(2 * g), "recur_f": rng.normal(0, 0.2, (H.HIDDEN, g)), "recur_b": rng.normal(0, 0.2, (H.HIDDEN, g)), "out_f": rng.normal(0, 0.3, H.HIDDEN), "out_b": rng.normal(0, 0.3, H.HIDDEN), "out": np.zeros(1)}
    w["bias"][H.HIDDEN : 2 * H.HIDDEN] = w["bias"][g + H.HIDDEN : g + 2 * H.HIDDEN] = 1
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    data = [(p := np.zeros((len(rows), H.PATHS)), [p.__setitem__((i, list(H.path_buckets(r[1]))), 1) for i, r in enumerate(rows) if r[1]])[0] for rows, _ in made]
    bags = [H.word_bags([r[0] for r in rows]).astype(float) for rows, _ in made]
    places = [H.counts(rows).astype(float) for rows, _ in made]
    step = 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(cut), key=lambda i: len(made[i][0]) // 4)
        batches = [order[i : i + 32] for i in range(0, cut, 32)]
        rng.shuffle(batches)
        loss = 0.0
        for batch in batches:
            sizes = np.array([len(made[i][0]) for i in batch])
            steps = sizes.max()
            mask = np.arange(steps)[None, :] < sizes[:, None]
            flat = [np.concatenate([x[i] for i in batch]) for x in (data, bags, places)]
            drop = rng.random((len(flat[0]), 1)) < 0.15  # some blocks are read without their path
            flat[0] = flat[0] * ~drop
            y = np.concatenate([made[i][1] for i in batch])
            x = flat[0] @ w["paths"] + flat[1] @ w["words"] + flat[2] @ w["counts"] + w["bias"]
            wide = np.zeros((len(batch), steps, 2 * g))
            wide[mask] = x
            back = np.where(mask, sizes[:, None] - 1 - np.arange(steps)[None, :], np.arange(steps)[None, :])
            lines = np.arange(len(batch))[:, None]
            f, tape_f = _forward(wide[:, :, :g], mask, w["recur_f"])
            b, tape_b = _forward(wide[lines, back][:, :, g:], mask, w["recur_b"])
            hb = b[lines, back]
            p = H.sigmoid(f @ w["out_f"] + hb @ w["out_b"] + w["out"])
            target = np.zeros(mask.shape)
            target[mask] = y
            loss += float(-(np.log(np.where(target > 0.5, p, 1 - p) + 1e-9) * mask).sum())
            d = (p - target) * mask / mask.sum()
            grad = {"out": d.sum(keepdims=True).reshape(1), "out_f": np.einsum("pt,pth->h", d, f), "out_b": np.einsum("pt,pth->h", d, hb)}
            dzf, grad["recur_f"] = _backward(d[:, :, None] * w["out_f"], tape_f, mask, w["recur_f"])
            dzb, grad["recur_b"] = _backward((d[:, :, None] * w["out_b"])[lines, back], tape_b, mask, w["recur_b"])
            dx = np.concatenate([dzf, dzb[lines, back]], axis=2)[mask]
            grad |= {"paths": flat[0].T @ dx, "words": flat[1].T @ dx, "counts": flat[2].T @ dx, "bias": dx.sum(axis=0)}
            step += 1
            for k in w:
                gk = np.clip(grad[k], -1, 1) + (1e-5 * w[k] if k in ("paths", "words") else 0)
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                w[k] -= rate * (0.6**(epoch // 4)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: loss {loss / sum(len(made[i][0]) for i in range(cut)):.4f}", flush=True)
    labeller = H.Labeller(w)
    found = labeller.scores([rows for rows, _ in made[cut:]])
    right = sum(int(((s > 0.5) == (y > 0.5)).sum()) for s, (_, y) in zip(found, made[cut:], strict=True))
    print(f"held out: {right / sum(len(y) for _, y in made[cut:]):.4f} of blocks right")
    return w


def _forward(x: np.ndarray, mask: np.ndarray, recur: np.ndarray) -> tuple[np.ndarray, list]:
    h, c = np.zeros((2, len(x), H.HIDDEN))
    out, tape, n = np.zeros((*mask.shape, H.HIDDEN)), [], H.HIDDEN
    for t in range(x.shape[1]):
        z = x[:, t] + h @ recur
        gates = H.sigmoid(z[:, : 3 * n])
        cand = np.tanh(z[:, 3 * n :])
        new = gates[:, n : 2 * n] * c + gates[:, :n] * cand
        tape.append((h, c, gates, cand, new))
        live = mask[:, t, None]
        h = np.where(live, gates[:, 2 * n :] * np.tanh(new), h)
        c = np.where(live, new, c)
        out[:, t] = h
    return out, tape


def _backward(dout: np.ndarray, tape: list, mask: np.ndarray, recur: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = H.HIDDEN
    dh, dc = np.zeros((2, len(dout), n))
    dz, drecur = np.zeros((*mask.shape, 4 * n)), np.zeros_like(recur)
    for t in range(mask.shape[1] - 1, -1, -1):
        h, c, gates, cand, new = tape[t]
        live = mask[:, t, None]
        dh = dh + dout[:, t]
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        squashed = np.tanh(new)
        dnew = dc + dh * o * (1 - squashed**2)
        z = np.concatenate([dnew * cand * i * (1 - i), dnew * c * f * (1 - f), dh * squashed * o * (1 - o), dnew * i * (1 - cand**2)], axis=1) * live
        dz[:, t] = z
        drecur += h.T @ z
        dh = np.where(live, z @ recur.T, dh)
        dc = np.where(live, dnew * f, dc)
    return dz, drecur


if __name__ == "__main__":
    H.MODEL.parent.mkdir(exist_ok=True)
    np.savez_compressed(H.MODEL, **{k: x.astype(np.float16) for k, x in train().items()})
