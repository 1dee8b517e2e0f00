"""Trains the licence classifier on templates it varies itself: `python -m docsafe.llm.train_licenses`."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from docsafe.llm import license_scan as L

SYLLABLES = "an be co da el fi go ha in jo ka li mo ne or pa qui re sa ti un va we xe yo za éa ön ñi st th er ou ing tion".split()
#: Prose about licences and near their words that names none.
PROSE = [
    "The driver showed a licence to the officer and was granted permission to go on.", "She has been licensed to practise medicine since last year.",
    "General public opinion of the version was mixed.", "The software was released under pressure from the public.",
    "No warranty is given for this recipe, and conditions of any kind may apply.", "A copy of the letter was free of charge to any person.",
    "The terms of the contract and the following conditions were met in full.", "Work on the source of the river is available in the library.",
    "All rights reserved.", "The licence of the restaurant was not renewed.", "Attribution of the painting is under discussion.",
    "The foundation published a list of conditions and a disclaimer.", "Version 2.0 of the plan was distributed to the members.",
    "MIT and other universities published the work.", "The Apache helicopter needs no license.", "This program is sponsored by the city.",
    "The lesser general was made public by the foundation.", "Permission to use the hall for any purpose was granted without fee.",
    "The eclipse was seen by the public.", "The painting has been in the public domain since then.", "Free software is made by many people in their own time.",
    "Creative work of the commons is shared alike by its authors.",
    "Commercial use of the park is subject to the terms of the council.", "Copyright law was changed in that year.", "the and of to in is that for it as was with be by on",
]


def samples(n: int, seed: int) -> tuple[list[str], np.ndarray]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
    texts, labels = [], []
    for _ in range(n):
        c = r.randrange(2 * len(L.FAMILIES))
        if c < len(L.FAMILIES):
            w = r.choice(L.TEMPLATES[L.FAMILIES[c]]).split()
            if len(w) > 8:
                w = [x for x in w if r.random() > 0.04]
                if r.random() < 0.3:
                    s = r.randrange(max(1, len(w) - 8))
                    w = w[s : s + r.randint(8, 30)] if s == 0 or r.random() < 0.5 else w
            if r.random() < 0.3:
                w = [word() for _ in range(r.randint(1, 4))] + w
            if r.random() < 0.3:
                w = w + [word() for _ in range(r.randint(1, 4))]
            text, label = " ".join(w), c
        else:
            label = len(L.FAMILIES)
            x = r.random()
            if x < 0.5:
                text = " ".join(word() if r.random() < 0.7 else r.choice("the of and to in is that for it as was with be by this are or le la de und der die el".split()) for _ in range(r.randint(1, 120)))
            elif x < 0.8:
                w = r.choice(PROSE).split()
                text = " ".join(w[: r.randint(3, len(w))] + [word() for _ in range(r.randint(0, 10))])
            else:  # words of the templates, in no order
                w = r.choice(L.TEMPLATES[r.choice(L.FAMILIES)]).split()
                r.shuffle(w)
                text = " ".join(r.sample(w, min(len(w), r.randint(1, 3))) + [word() for _ in range(r.randint(2, 20))])
        texts.append(text.upper() if r.random() < 0.05 else text)
        labels.append(label)
    return texts, np.array(labels)


def matrix(texts: list[str]) -> np.ndarray:
    bucket, text, n = L.buckets(pa.array(texts))
    x = np.zeros((len(texts), L.BUCKETS), np.float32)
    np.add.at(x, (text, bucket), 1)
    return x / np.maximum(np.sqrt(n), 1)[:, None]


def train(n: int = 8000, steps: int = 300, seed: int = 5) -> dict[str, np.ndarray]:
    texts, y = samples(n, seed)
    held, hy = samples(1500, seed + 1)
    x, k = matrix(texts), len(L.FAMILIES) + 1
    w, b = np.zeros((L.BUCKETS, k), np.float32), np.zeros(k, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    onehot = np.eye(k, dtype=np.float32)[y]
    for t in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - onehot) / len(x)
        g = x.T @ d + 2e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= 0.5 * d.sum(axis=0)
    z = matrix(held) @ w + b

    def loss(temperature: float) -> float:
        q = z / temperature
        q = q - q.max(axis=1, keepdims=True)
        return float(-(q[np.arange(len(q)), hy] - np.log(np.exp(q).sum(axis=1))).mean())

    temperature = min(np.geomspace(0.2, 5, 60), key=loss)
    print(f"held out: {(z.argmax(axis=1) == hy).mean():.4f} right, temperature {temperature:.2f}, loss {loss(temperature):.4f}")
    return {"weights": w.astype(np.float16), "bias": b, "temperature": np.float32(temperature)}


if __name__ == "__main__":
    L.MODEL.parent.mkdir(exist_ok=True)
    np.savez_compressed(L.MODEL, **train())
