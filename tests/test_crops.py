"""Crops and cuts of lines against plain versions and known images."""

import math

import numpy as np
from pyspark.sql import functions as F

from docsafe.functions import crops as C
from docsafe.plans import payloads
from docsafe.sources import tables


def test_corners_and_least_box():
    assert C.corners(np.array([(10, 10), (0, 10), (0, 0), (10, 0)], float)).tolist() == [[0, 0], [10, 0], [10, 10], [0, 10]]
    r = np.random.default_rng(1)
    for _ in range(60):
        points = r.normal(size=(r.integers(5, 20), 2)) * (30, 6)
        box = C.least_box(points)
        area = lambda b: np.linalg.norm(b[1] - b[0]) * np.linalg.norm(b[2] - b[1])
        turns = [np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]]) for a in np.linspace(0, math.pi / 2, 721)]
        plain = min(np.prod(np.ptp(points @ t, axis=0)) for t in turns)
        assert area(box) <= plain + 1e-9 and area(box) >= plain * 0.97
        u, v = box[1] - box[0], box[3] - box[0]
        inside = np.stack([(points - box[0]) @ u / (u @ u), (points - box[0]) @ v / (v @ v)])
        assert (inside > -1e-9).all() and (inside < 1 + 1e-9).all()
    assert C.least_box(np.array([(1, 2), (3, 2), (5, 2), (9, 2), (4, 2)], float)).tolist() == [[1, 2], [9, 2], [9, 2], [1, 2]]


def test_straightened():
    page = np.full((60, 120), 255, np.uint8)
    page[20:31, 30:71] = np.arange(41)[None, :] * 4
    upright = C.straightened(page, [(30, 20), (70, 20), (70, 30), (30, 30)])
    assert upright.shape == (10 + 2, 40 + 2 * 2)
    m = upright[1:-1, 2:-2].astype(int)
    assert np.abs(m - np.linspace(0, 160, 40)[None, :]).max() <= 2
    t = math.radians(12)  # a turned line comes back level
    y, x = np.mgrid[:160, :200].astype(float)
    u, v = (x - 40) * math.cos(t) + (y - 40) * math.sin(t), (y - 40) * math.cos(t) - (x - 40) * math.sin(t)
    turned = np.where((u >= 0) & (u <= 100) & (v >= 0) & (v <= 20), np.where(v < 10, 40, 200), 255).astype(np.uint8)
    at = lambda a, b: (40 + a * math.cos(t) - b * math.sin(t), 40 + a * math.sin(t) + b * math.cos(t))
    got = C.straightened(turned, [at(0, 0), at(100, 0), at(100, 20), at(0, 20)], 0.05)
    assert abs(int(got[4:8, 10:90].mean()) - 40) <= 3 and abs(int(got[14:18, 10:90].mean()) - 200) <= 3
    assert C.straightened(page[:0], [(0, 0)] * 4).size == 0
    assert (C.straightened(page, [(-30, -30), (-10, -30), (-10, -20), (-30, -20)]) == 255).all()


def line(widths, gap, height=32):
    """Bars of ink with blanks between."""
    return np.concatenate([np.concatenate([np.zeros((height, w), np.uint8), np.full((height, gap), 255, np.uint8)], axis=1) for w in widths], axis=1)


def test_segments():
    g = line([90] * 14, 12)
    parts = C.segments(g)
    assert len(parts) > 1 and [p.core_left for p in parts[1:]] == [p.core_right for p in parts[:-1]]
    assert parts[0].core_left == 0 and parts[-1].core_right == g.shape[1] and [p.is_tail for p in parts] == [False] * (len(parts) - 1) + [True]
    for p in parts:
        a = np.frombuffer(p.samples, np.uint8).reshape(32, p.width)
        assert (a[:, 2:-2] == g[:, p.source_left : p.source_right]).all() and (a[:, :2] == 255).all() and C.resized(p.width, 32, 32) <= 512
        assert all((g[:, c] == 255).all() for c in (p.core_left, p.core_right - 1) if 0 < c < g.shape[1] - 1)
    for overlap in (0.1, 0.5, 2.0):
        for p, q in zip(laps := C.segments(g, overlap=overlap), laps[1:], strict=False):
            assert p.source_right - p.core_right <= round(32 * overlap) and q.source_left <= q.core_left and p.width <= 512
    one = lambda x: [(p.core_left, p.core_right, p.is_tail, p.width) for p in x]
    for whole in (line([100], 5), np.zeros((32, 900), np.uint8), line([600, 30], 12)):  # it fits; no blank; a bar too wide
        assert one(C.segments(whole)) == [(0, whole.shape[1], True, whole.shape[1])]
    assert C.segments(g[:, :0]) == []
    short = C.segments(line([90] * 60, 12))  # more segments than are allowed: the last would not fit
    assert len(short) == 1


def test_places_by_search():
    r = np.random.default_rng(4)
    for _ in range(300):
        width = int(r.integers(600, 3000))
        found = np.array(sorted({(int(c), int(r.integers(2, 6)), round(float(r.random()) / 50, 3)) for c in r.integers(0, width, 25)}), float)
        wanted, cap, margin, most = 400, 470, 96, 6
        cuts, at = [0], 0
        while cuts is not None and width - at > cap and len(cuts) < most:
            fit = [f for f in found.tolist() if at + margin <= f[0] <= min(width - margin, at + cap)]
            cuts = [*cuts, at := int(min(fit, key=lambda f: (abs(f[0] - at - wanted), -f[1], f[2]))[0])] if fit else None
        assert C.places(found, width, wanted, cap, margin, most) == (None if cuts is None else [*cuts, width])


def test_columns(spark):
    g = line([90] * 14, 12)
    rows = [(1, g.tobytes(), g.shape[1], [[0.0, 0.0], [90.0, 0.0], [90.0, 31.0], [0.0, 31.0]]), (2, None, None, None), (3, b"", 0, [])]
    df = spark.createDataFrame(rows, "i int, data binary, width int, points array<array<double>>")
    out = {r["i"]: r for r in df.select("i", C.line_crop("data", "width", "points").alias("c"), C.line_segments("data", "width").alias("s"), C.box_crop("data", "width", F.lit(3), F.lit(1), F.lit(8), F.lit(5)).alias("b")).collect()}
    assert out[1]["c"]["width"] == 90 + 2 * 4 and len(out[1]["s"]) == len(C.segments(g)) and bytes(out[1]["b"]["samples"]) == g[1:5, 3:8].tobytes()
    assert all(out[i]["c"]["width"] == 0 and out[i]["s"] == [] for i in (2, 3))
    assert C.widened(np.zeros((32, 50), np.uint8), 100).shape == (32, 100) and C.widened(np.zeros((32, 50), np.uint8), 50).shape == (32, 50)


def _many(lines, **more):
    runs = [C.ink_runs(g) for g in lines]
    flat = [np.concatenate([np.zeros(0, int), *(r[i] for r in runs)]) for i in (0, 1)]
    cuts = C.many_segments(*flat, np.array([len(r[0]) for r in runs], int), lines[0].shape[0], **more)
    assert all(x.tolist() == y for x, y in zip(cuts[:2], ([i for i, g in enumerate(lines) for _ in C.segments(g, **more)], [k for g in lines for k, _ in enumerate(C.segments(g, **more))]), strict=True))
    return [*zip(*(x.tolist() for x in cuts[2:]), strict=True)]


def test_many_segments():
    """Many lines by their ink against each line by its samples."""
    r, counts = np.random.default_rng(8), set()
    for h in (1, 7, 8, 32, 45):
        for more in ({}, {"overlap": 0.5}, {"overlap": 2.0, "most": 4}, {"most_ink": 0.1, "widest": 256}):
            lines = [np.zeros((h, 0), np.uint8), np.full((h, 40 * h), 255, np.uint8), np.zeros((h, 40 * h), np.uint8)]
            for _ in range(25):  # bars of words, blanks that differ or not, specks
                gap = [r.integers(1, max(2, h)) if r.random() < 0.5 else max(1, h * 12 // 32) for _ in range(r.integers(1, 40))]
                g = np.concatenate([x for k in gap for x in (np.zeros((h, r.integers(1, 4 * h + 2)), np.uint8), np.full((h, k), 255, np.uint8))], axis=1)
                g[r.random(g.shape) < r.choice([0, 0.005, 0.05])] = 100
                lines.append(g)
            want = [(p.core_left, p.core_right, p.source_left, p.source_right, p.ink, p.ink_columns, p.is_tail, p.width) for g in lines for p in C.segments(g, **more)]
            assert _many(lines, **more) == want
            counts |= {len(C.segments(g, **more)) for g in lines}
    assert counts >= {0, 1, 2, 3, 4, 5}


def test_query_of_wide_lines(spark, tmp_path, monkeypatch):
    """The query gives what the images of its lines give, and makes none of them."""
    r = np.random.default_rng(2)
    word = lambda: str(r.choice(["đường", "a", "été", "--", "😀😀", "long" * 9, "\u00a0", "x\u2003y", "long" * 40]))
    docs = [(i, "\n".join(word() for _ in range(r.choice([0, 1, 15, 16, 17, 33, 70])))) for i in range(60)] + [(60, None), (61, " \n\t")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(payloads, "AT_ONCE", 1000)
    got = payloads.wide_cuts(spark, str(tmp_path))
    assert "repeat" not in got._jdf.queryExecution().executedPlan().toString()
    want = []
    for x in tables.printed(spark, str(tmp_path)).collect():
        row = np.concatenate([np.full(12, 255 if c == " " else 65, np.uint8) for c in x["text"]])
        want += [(x["doc_id"], x["line_no"], k, p.core_left, p.core_right, p.is_tail, round(p.ink_columns, 6)) for k, p in enumerate(C.segments(np.tile(row, (32, 1))))]
    assert sorted(map(tuple, got.collect())) == sorted(want) and {k for _, _, k, *_ in want} > {0, 1, 2}
