"""Spans without ground, against a plain search over every trace."""

import random
import re
from statistics import mean, median

import pytest
from pyspark.sql import functions as F

from docsafe.operators import spans

TRACE = "i int, text string, p array<double>, c array<double>, s array<double>, last_ink double, near_loop long"


def brute(text, p, c, s, last_ink, loop):
    n = min(len(text or ""), len(p or ()), len(c or ()), len(s or ()))
    if n < 11:
        return None
    text, old = text[:n], max(8, n - 6)
    pf, sf = min(0.72, max(0.56, 0.68 * median(p[:old]))), min(0.18, max(0.10, 0.28 * median(s[:old])))
    over = lambda a, x, y: mean(a[x:y])
    run = n
    while run and p[run - 1] < pf and s[run - 1] < sf:
        run -= 1

    def state(x, dp, ds, de):
        still = max(c[x:n]) - min(c[x:n]) <= 0.035 and over(p, x, n) <= pf + dp and over(s, x, n) <= sf + ds
        return still, over(c, x, n) >= last_ink - 0.06 and over(s, x, n) <= sf and over(p, x, n) <= pf + de

    still, spent = state(run, 0, 0, 0) if n - run >= 3 else (False, False)
    start, why, taken = None, None, 0
    if loop is not None and (still or spent or any(state(n - 6, 0.05, 0.03, 0.04))):
        start, why = loop, "attention_near_loop"
    elif spent or still:
        start, why = run, "visual_evidence_exhausted" if spent else "attention_stall"
        while taken < 2:
            found = list(re.finditer(r"\w+", text[:start]))
            if not found or re.search(r"\d", found[-1][0]) or found[-1].start() < 8:
                break
            a, b = found[-1].span()
            wp, wc, ws = (over(x, a, b) for x in (p, c, s))
            place = abs(wc - over(c, start, n)) <= 0.08 and max(c[a:n]) - min(c[a:n]) <= 0.12 and wc >= last_ink - 0.10
            if not (place and ws <= min(0.16, max(sf, 0.35 * median(s[:a]))) and (wp <= min(0.82, max(pf + 0.12, 0.9 * median(p[:a]))) or ws <= 0.55 * sf)):
                break
            start, taken = a, taken + 1
    if start is not None and len(text[:start].rstrip()) >= 8 and text[start:].strip():
        head = text[:start].rstrip()
        return why, "suffix", len(head), n, taken, " ".join(head.split()), text[start:].strip(), bool(re.search(r"\d", text[start:]))
    found = [m.span() for m in re.finditer(r"\w+", text)]
    rows = [tuple(over(x, *w) for x in (p, c, s)) for w in found]
    weak = [r[0] <= min(0.72, pf + 0.10) and r[2] <= min(0.18, 1.25 * sf) for r in rows]
    best = None
    for i in range(1, len(rows)):
        j = next((j for j in range(i, len(rows)) if not weak[j]), len(rows))
        if weak[i - 1] or i == j or j == len(rows) or j - i > 12:
            continue
        (op, oc, os), (lp, lc, ls), (rp, rc, rs) = (tuple(map(mean, zip(*x, strict=True))) for x in (rows[i:j], rows[max(0, i - 2) : i], rows[j : j + 2]))
        a, b = found[i][0], found[j - 1][1]
        wide = max(c[a:b]) - min(c[a:b])
        ok = a >= 8 and n - b >= 6 and (b - a) / n <= 0.55 and min(lp, rp) >= max(pf, 1.2 * op) and min(ls, rs) >= max(sf, 1.8 * os)
        ok = ok and (wide <= 0.12 or abs(c[b - 1] - c[a]) <= 0.04) and (min(abs(oc - lc), abs(oc - rc)) <= 0.10 or rc - oc >= 0.05)
        ok = ok and rc - lc >= 0.08 and rc >= oc - 0.10 and os <= 0.55 * min(ls, rs) and op <= 0.82 * min(lp, rp)
        score = min(ls, rs) - os + min(lp, rp) - op + max(0, rc - lc) + max(0, rc - oc) - wide
        if ok and (best is None or score > best[0]):
            best = (score, a, b)
    if best is None:
        return None
    _, a, b = best
    return "unsupported_midline_span", "midline", a, b, 0, " ".join(f"{text[:a].rstrip()} {text[b:].lstrip()}".split()), text[a:b], bool(re.search(r"\d", text[a:b]))


def made(seed):
    r = random.Random(seed)
    n = r.choice([5, 11, 24, 40, 64])
    text = "".join(r.choice(["ab cđ", "x7", "êu ", " ", "mno"]) for _ in range(n))[:n].replace("  ", " a").ljust(n, "z")
    at, size = r.randrange(n), r.randrange(3, 20)
    end = r.random() < 0.5
    inside = [(k >= at if end else at <= k < at + size) for k in range(n)]
    halfway = [end and at - 9 <= k < at for k in range(n)]
    rnd = lambda a, b: round(r.uniform(a, b), 4)
    p = [rnd(0.2, 0.4) if x else rnd(0.5, 0.75) if h else rnd(0.85, 1.0) for x, h in zip(inside, halfway, strict=True)]
    s = [rnd(0.0, 0.03) if x else rnd(0.02, 0.16) if h else rnd(0.3, 0.6) for x, h in zip(inside, halfway, strict=True)]
    c = [round(at / n + rnd(0, 0.02), 4) if x or h else round(k / n, 4) for k, (x, h) in enumerate(zip(inside, halfway, strict=True))]
    return text, p, c, s, r.choice([0.3, 0.6, 0.9, 1.0]), r.choice([None, None, None, r.randrange(n)])


def test_cuts(spark):
    rows = [made(i) for i in range(1500)]
    rows += [(None, [0.5], [0.5], [0.5], 0.5, None), ("", [], [], [], 1.0, None), ("abc def ghi jkl", None, [0.1] * 15, [0.1] * 15, 0.9, None), ("abcdef ghij klmno pqr", [0.9] * 12, [0.1] * 21, [0.5] * 30, 0.9, 3)]
    got = spans.cuts(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], TRACE))
    found = {r["i"]: tuple(r)[1:] for r in got.where("reason is not null").select("i", "reason", "kind", "start", "end", "taken", "kept", "removed", "numeric").collect()}
    want = {i: b for i, r in enumerate(rows) if (b := brute(*r))}
    assert found == want
    assert {w[0] for w in want.values()} == {"visual_evidence_exhausted", "attention_stall", "attention_near_loop", "unsupported_midline_span"}
    assert {w[4] for w in want.values()} == {0, 1, 2} and {w[7] for w in want.values()} == {True, False}


@pytest.mark.parametrize(("text", "start", "end", "kept"), [("ab cd ef", 3, 5, "ab ef"), ("ab(cd)ef", 2, 6, "ab ef"), ("ab, cd", 2, 3, "ab cd"), ("a-b-c", 1, 4, "a c"), ("a. x", 1, 2, "a x"), ("x", 0, 1, ""), (" ab", 0, 1, "ab")])
def test_sides_are_joined(spark, text, start, end, kept):
    assert spark.range(1).select(spans.without(F.lit(text), F.lit(start), F.lit(end)).alias("x")).first()["x"] == kept
