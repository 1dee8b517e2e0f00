"""Ends without ground against a plain search over all their lengths."""

import random
import statistics as st

import pytest

from docsafe.operators import seams
from docsafe.plans import payloads
from docsafe.sources import tables

KEYS = ("text", "p", "c", "s", "gain", "reuse", "image", "border", "left", "source", "line")


def made(r, weak):
    """Two traces; the end of the first has little ground."""
    words = [r.choice(["đường", "to", "river", "12", "a", "longer", "x"]) for _ in range(r.randint(1, 9))]
    text = " ".join(words)
    n, bad = len(text), len(" ".join(words[-weak:])) if weak else 0
    near = lambda good, low: [round(r.uniform(*(low if i >= n - bad else good)), 3) for i in range(n)]
    c = [min(1.0, (i + 1) / (n - bad + 1)) if i < n - bad else 0.9 for i in range(n)]
    t = dict(text=text, p=near((0.7, 1), (0.2, 0.9)), c=c, s=near((0.2, 0.6), (0, 0.2)), gain=near((0.5, 0.9), (0, 0.35)), reuse=near((0, 0.3), (0.4, 1)), image=300, border=2, left=r.choice([0, 290]), source=296, line=600)
    return t


def plain(a, b):
    """Every length by itself, all conditions spelled out on characters."""
    import re

    if not a["gain"] or not b["gain"]:
        return None
    words = lambda t: [(m.start(), m.end()) for m in re.finditer(r"\w+", t["text"])]
    wa, wb = words(a), words(b)
    if len(wa) < 2 or not wb:
        return None
    of = lambda t, k, ws: st.fmean(st.fmean(t[k][i:j]) for i, j in ws)
    place = lambda t, i: min(1.0, max(0.0, (t["left"] + min(t["source"], max(0.0, t["c"][i] * t["image"] - t["border"]))) / t["line"]))
    n = len(a["text"])
    stable = max(8, n - min(6, n))
    floor_p = min(0.72, max(0.56, 0.68 * st.median(a["p"][:stable])))
    floor_s = min(0.18, max(0.10, 0.28 * st.median(a["s"][:stable])))
    head, best = wb[:2], None
    for k in range(1, min(12, len(wa) - 1) + 1):
        span, before = wa[len(wa) - k :], wa[max(0, len(wa) - k - 2) : len(wa) - k]
        i, j = span[0][0], span[-1][1]
        ref = {m: max(1e-6, min(of(a, m, before), of(b, m, head))) for m in ("p", "s", "gain")}
        limit_p, limit_s, limit_g = 0.92 * ref["p"], 0.68 * ref["s"], max(0.20, 0.58 * ref["gain"])
        holds = [
            i >= 8, len(" ".join(a["text"][:i].split())) >= 8, of(b, "p", head) >= max(floor_p, 0.58), of(b, "s", head) >= max(floor_s, 0.10),
            all(of(a, "s", [w]) <= limit_s and of(a, "gain", [w]) <= limit_g and (of(a, "p", [w]) <= limit_p or of(a, "s", [w]) <= 0.055) for w in span),
            of(a, "s", span) <= limit_s + 1e-12, of(a, "gain", span) <= limit_g + 1e-12, of(a, "p", span) <= limit_p or of(a, "s", span) <= 0.055,
            of(a, "reuse", span) >= 0.60 or abs(place(a, j - 1) - place(a, i)) <= 0.045,
            st.fmean(place(b, x) for x in range(head[-1][1])) >= st.fmean(place(a, x) for x in range(i, j)) - 0.03,
        ]
        if all(holds):
            score = ref["s"] - of(a, "s", span) + ref["gain"] - of(a, "gain", span) + of(a, "reuse", span)
            if best is None or (k, score) > best[:2]:
                best = (k, score, i, j)
    return best


def test_search():
    r, found, kept = random.Random(5), 0, 0
    for _ in range(3000):
        a, b = made(r, r.randint(0, 4)), made(r, 0) | {"left": 300}
        got, want = seams.gap(a, b), plain(a, b)
        assert (got is None) == (want is None)
        if got:
            assert (got.words, got.start, got.end) == (want[0], want[2], want[3]) and abs(got.score - want[1]) < 1e-9
            assert got.removed == a["text"][want[2] : want[3]] and got.numeric == any(x.isdigit() for x in got.removed)
            found += 1
        kept += not got
    assert found > 50 and kept > 50


def test_reasons():
    r = random.Random(1)
    a = made(r, 0)
    assert seams.rejected(a | {"gain": []}, a) == seams.rejected(None, a) == ["coverage_metrics_unavailable"]
    one = a | {"text": "x"}
    assert seams.rejected(one, a) == ["insufficient_words"] and seams.gap(one, a) is None and seams.gap(a, None) is None
    flat = dict(text="aa bb cc", p=[0.9] * 8, c=[0.5] * 8, s=[0.5] * 8, gain=[0.5] * 8, reuse=[0.0] * 8)
    assert seams.rejected(flat, flat) == ["tail_coverage_not_lower", "tail_support_not_lower", "tail_attention_not_reused"]
    low = flat | dict(s=[0.1] * 8, gain=[0.1] * 8, reuse=[0.9] * 8)
    assert seams.rejected(low, flat) == ["boundary_not_confident"]
    assert seams.diagnostics(low, flat)["tail_reuse_ratio_mean"] == 0.9 and seams.diagnostics(None, flat)["tail_support_mean"] == 0.0
    assert seams.Trace(flat | {"gain": [0.2]}).means[:, 2].tolist() == [1.0] * 3  # too short


def test_columns(spark):
    r = random.Random(9)
    rows = [(i, tuple(made(r, 3)[k] for k in KEYS), tuple((made(r, 0) | {"left": 300})[k] for k in KEYS)) for i in range(60)] + [(60, None, None)]
    df = spark.createDataFrame(rows, f"i int, a {seams.TRACE}, b {seams.TRACE}")
    got = {x["i"]: x for x in df.select("i", seams.judged("a", "b").alias("j")).select("i", "j.*").collect()}
    for i, a, b in rows:
        want = seams.gap(*(dict(zip(KEYS, t, strict=True)) if t else None for t in (a, b)))
        assert (got[i]["cut"]["words"] if got[i]["cut"] else None) == (want.words if want else None)
    assert got[60]["reasons"] == ["coverage_metrics_unavailable"] and got[60]["diagnostics"]["right_support_mean"] == pytest.approx(0)


def test_many_at_once():
    r = random.Random(11)
    a = [made(r, r.randint(0, 4)) for _ in range(1200)] + [None, made(r, 2) | {"gain": []}, made(r, 2) | {"gain": [0.2]}, made(r, 0) | {"text": "x"}, made(r, 0) | {"text": ""}]
    b = [made(r, r.choice([0, 0, 1])) | {"left": 300} for _ in a]
    for t in a[:300]:  # measures in tenths: means that lie on a limit
        t |= {k: [round(x, 1) for x in t[k]] for k in ("p", "s", "gain", "reuse")}
    x, y, n = seams.Traces.of(a), seams.Traces.of(b + [None]), len(a)
    i, j = [*range(n), 0, 1], [*range(n), n, 0]
    side = lambda ts: seams.Placed(*[[(ts[0] if t is None else t)[k] for t in ts] for k in seams.Placed._fields])
    pairs = [(a[u], (b + [None])[v]) for u, v in zip(i, j, strict=True)]
    got = seams.judge(x, y, seams.np.array(i), seams.np.array(j), side([u for u, _ in pairs]), side([v for _, v in pairs]))
    want = [(cut := seams.gap(*p), [] if cut else seams.rejected(*p)) for p in pairs]
    assert got == want and sum(cut is not None for cut, _ in got) > 50 and len({tuple(why) for _, why in got}) > 5
    assert seams.judge(x, y, seams.np.array([], int), seams.np.array([], int), side([a[0]]), side([b[0]])) == []


def test_words():
    import re

    text = "".join(map(chr, range(0x110000)))
    for t in (text, text[::7], "a", " a_1 ", ""):
        start, end = seams.words(t)
        assert [*zip(start.tolist(), end.tolist(), strict=True)] == [m.span() for m in re.finditer(r"\w+", t)]


def test_query_of_lines(spark, tmp_path, monkeypatch):
    """The query gives what the columns of whole traces give, and sends neither those nor rows between tasks."""
    r = random.Random(3)
    word = lambda: r.choice(["đường", "a", "été", "12", "--", "😀", "long" * 9, "river", "x_y"])
    docs = [(i, " ".join(word() for _ in range(r.choice([0, 1, 15, 16, 17, 33, 70, 200])))) for i in range(-3, 60)] + [(60, None), (61, " \n\t"), (62, "a" * 5000 + "\n" + "b c " * 40)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(payloads, "AT_ONCE", 3000)
    got = payloads.segment_gaps(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "array<double>" not in plan
    lines = {(x["doc_id"], x["line_no"]): x["text"] for x in tables.printed(spark, str(tmp_path)).collect()}

    def trace(doc, text, left):
        n = len(text)
        at = lambda good, low: [low if x > n - 12 * (doc % 3 if doc >= 0 else -(-doc % 3)) else good for x in range(1, n + 1)]
        return dict(zip(KEYS, (text, at(0.95, 0.6), [x / n for x in range(1, n + 1)], at(0.4, 0.05), at(0.8, 0.1), at(0.1, 0.9), 300, 2, left, 296, 600), strict=True))

    want = {}
    for (doc, line), text in lines.items():
        if (doc, line + 1) in lines:
            pair = trace(doc, text, 0), trace(doc, lines[doc, line + 1], 300)
            cut = seams.gap(*pair)
            want[doc, line] = (cut.removed, cut.words, round(cut.score, 6), "") if cut else (None, None, None, ",".join(seams.rejected(*pair)))
    got = {(x["doc_id"], x["line_no"]): tuple(x)[2:] for x in got.collect()}
    assert got == want and len({x[3] for x in want.values()}) > 3
