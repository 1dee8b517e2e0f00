"""Operators do the whole job: every page, box, word and form, against brute force on small fixtures."""

import random
import re

import pytest

from docsafe.functions import readings as R
from docsafe.operators import layout, order
from docsafe.plans import catalogue
from docsafe.sources import tables

SF = "/root/testdata/sf0.001"
BOX = "page long, line long, x0 double, y0 double, x1 double, y1 double"


def score(a, b):
    across = max(min(a[4], b[4]) - max(a[2], b[2]), 0.0) / max(min(a[4] - a[2], b[4] - b[2]), 1.0)
    down = max(min(a[5], b[5]) - max(a[3], b[3]), 0.0) / max(min(a[5] - a[3], b[5] - b[3]), 1.0)
    return 0.75 * min(down, 1.0) + 0.25 * min(across, 1.0)


def made_boxes(seed, n=60):
    r = random.Random(seed)
    out = []
    for line in range(n):
        x, y = r.randrange(0, 400), r.randrange(-40, 200)
        out.append((r.randrange(3) * 90, line, float(x), float(y), float(x + r.randrange(0, 200)), float(y + r.choice([0, 3, 20, 32, 64, 150]))))
    return [*out, (0, n, 0.0, None, 5.0, 5.0), (0, n + 1, 0.0, 9.0, 5.0, 4.0)]


def brute_pairs(a, b, least=0.55):
    whole = lambda rows: [r for r in rows if None not in r]
    return {(x[0], x[1], y[1], score(x, y)) for x in whole(a) for y in whole(b) if x[0] == y[0] and score(x, y) >= least}


def test_candidates_are_all_pairs_of_every_page(spark):
    a, b = made_boxes(1), made_boxes(2)
    got = [tuple(r) for r in layout.match_candidates(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(a, b)
    with pytest.raises(ValueError, match="no band"):
        layout.match_candidates(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), 0.25)


def test_page_candidates_leave_no_page_out(spark):
    boxes = [tuple(r) for r in tables.boxes(spark, SF).drop("conf").collect()]
    side = lambda k: [r for r in boxes if r[1] // 8 % 2 == k]
    got = {tuple(r) for r in catalogue.queries()["j2_spatial_candidates"](spark, SF).collect()}
    assert got == brute_pairs(side(0), side(1)) and len({r[0] for r in got}) >= 20


def test_every_box_is_matched_greedily(spark):
    boxes = [tuple(r) for r in tables.boxes(spark, SF).drop("conf").collect()]
    moved = [(p, n, *(x + 2 for x in sides)) for p, n, *sides in boxes]
    want, crops, others = set(), set(), set()
    for page, crop, other, s in sorted(brute_pairs(boxes, moved), key=lambda r: (r[3], r[1], r[2]), reverse=True):
        if (page, crop) not in crops and (page, other) not in others:
            want.add((page, crop, other, s))
            crops.add((page, crop))
            others.add((page, other))
    assert {tuple(r) for r in catalogue.queries()["j2_one_to_one"](spark, SF).collect()} == want
    assert {r[1] % 4 for r in want} == {0, 1, 2, 3}


def test_word_evidence_of_every_line(spark):
    want = set()
    for r in tables.printed(spark, SF).collect():
        for k, m in enumerate(re.finditer(r"\w+", r["text"])):
            p = [((i + 1) * 37 % 100) / 100 for i in range(*m.span())]
            want.add((r["doc_id"], r["line_no"], k, m[0], m.start(), round(sum(p) / len(p), 6)))
    assert {tuple(r) for r in catalogue.queries()["a15_word_evidence"](spark, SF).collect()} == want
    assert max(r[1] for r in want) >= 3


def brute_loop(t):
    """The reference's search, by slices."""
    n, best = len(t), None
    for k in range(1, min(4, n // 3) + 1):
        for s in range(n - 3 * k + 1):
            c = 1
            while t[s + c * k : s + (c + 1) * k] == t[s : s + k]:
                c += 1
            if c >= 3 and (best is None or (c, 0, k) > best[0]):
                best = ((c, 0, k), s)
    for k in range(2, min(4, n // 2) + 1):
        for s in range(n - 2 * k):
            rest = t[s + 2 * k :]
            if t[s : s + k] == t[s + k : s + 2 * k] and 0 < len(rest) < k and 2 * len(rest) >= k and rest == t[s : s + len(rest)] and (best is None or (2, len(rest), k) > best[0]):
                best = ((2, len(rest), k), s)
    return best


def test_loops_whole_and_partial(spark):
    r = random.Random(5)
    texts = ["q r a b c d a b c d a b", "a b a b", "xin chao a b a b a b", "a b a b a", "a b c a b c a", "", "a", *(" ".join(r.choice("ab" if i % 2 else "abcd") for _ in range(r.randrange(16))) for i in range(600))]
    for k, cut in [(2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3)] * 6:
        unit = r.sample("abcdef", k)
        texts.append(" ".join([*r.sample("uvw", 2), *unit, *unit, *unit[:cut]]))
    rows = [(i, p, w) for i, t in enumerate(texts) for p, w in enumerate(t.split())]
    got = {x["i"]: ((x["repeats"], x["partial"], x["ngram"]), x["start"]) for x in order.ngram_loops(spark.createDataFrame(rows, "i long, pos long, tok string"), ["i"]).collect()}
    want = {i: b for i, t in enumerate(texts) if (b := brute_loop(t.split()))}
    assert got == want and got[0] == ((2, 2, 4), 2) and sum(b[0][1] > 0 for b in want.values()) > 20


def test_seam_merge(spark):
    pairs = [("ben an", "an toan", "ben an toan", True), ("x", ", y", "x, y", False), ("so A.B", "a.b, c", "so A.B c", True), ("nay hop dong", "dong- mua", "nay hop dong mua", True),
             ("xem (abcde", "abcde", "xem (abcde", True), ("a -- (+)", "-- (+) b", "a -- (+) b", True), ("xabcd", "abcde", "xabcd abcde", False), ("", " b  c", "b c", False), (None, "a", "a", False), ("a", None, "a", False)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(pairs)], "i int, a string, b string").select("i", R.seam_merge("a", "b").alias("m")).select("i", "m.*").collect()
    assert [tuple(r)[1:] for r in sorted(got)] == [tuple(p[2:]) for p in pairs]


def test_duplicates_share_text_and_place(spark):
    at = lambda y: (0.0, float(y), 100.0, float(y + 20))
    lines = [(1, 0, "a", 0.9, "none", ["x"], *at(0)), (1, 1, "a", 0.5, "high", ["y", "x"], *at(1)), (1, 2, "a", 0.7, "medium", ["z"], *at(2)), (1, 3, "a", 0.8, "none", [], *at(5)),
             (1, 4, "b", 0.8, "none", [], *at(5)), (1, 5, "", 0.8, "none", [], *at(5)), (1, 6, "", 0.8, "none", [], *at(5)), (2, 0, "a", 0.1, "none", [], *at(0)), (2, 1, "a", 0.1, "none", [], *at(40))]
    got = order.geometric_duplicates(spark.createDataFrame(lines, "page long, line_no long, text string, conf double, risk string, reasons array<string>, x0 double, y0 double, x1 double, y1 double"))
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 0, "a", 0.5, "high", ["x", "y", "z"], 3), (1, 3, "a", 0.8, "none", [], 1), (1, 4, "b", 0.8, "none", [], 1), (1, 5, "", 0.8, "none", [], 1), (1, 6, "", 0.8, "none", [], 1),
        (2, 0, "a", 0.1, "none", [], 1), (2, 1, "a", 0.1, "none", [], 1)]
