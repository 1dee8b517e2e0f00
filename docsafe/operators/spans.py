"""Spans of a reading that its image does not bear out: what a trimmed end takes along, and words amid a line.

Rows are traces: text, and by character p (probability), c (centre of attention), s (ink support). All is done in arrays
of the row, without a shuffle; the work grows with the words of a trace times its weak runs, and a decoder bounds both.
Texts longer than their arrays are read as far as the shortest of them; null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsafe.functions import text as T
from docsafe.functions import traces
from docsafe.operators import evidence

WORD = r"[\p{L}\p{N}_]"
MEASURES = ("p", "c", "s")


def _part(a: Column, start: Column, end: Column) -> Column:
    return F.slice(a, start + 1, F.greatest(end - start, F.lit(0)))


def _median(a: Column) -> Column:
    return traces.middle(F.array_sort(a))


def _mean_of(ws: Column, name: str) -> Column:
    return traces.mean(F.transform(ws, lambda w: w[name]))


def _has_digit(t: Column) -> Column:
    return F.regexp_like(t, F.lit(r"\p{Nd}"))


def settled(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that filters of later steps are not pushed through: pushed, they would write out all that the
    column is made of, and that once for each of its uses."""
    return rows.withColumn(name, F.explode_outer(F.array(value)))


def aligned(rows: DataFrame, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """rows with text and measures cut to the length of the shortest."""
    n = F.least(F.length(F.coalesce("text", F.lit(""))), *[F.coalesce(F.size(m), F.lit(0)) for m in measures])
    out = rows.withColumn("_n", F.greatest(n, F.lit(0)))
    cut = {m: F.when(F.col(m).isNull(), F.array().cast("array<double>")).otherwise(F.slice(m, F.lit(1), F.col("_n"))) for m in measures}
    return out.withColumns({"text": F.substring(F.coalesce("text", F.lit("")), F.lit(1), F.col("_n")), **cut}).drop("_n")


def words(rows: DataFrame, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """rows with ws: the words of a trace, each with the means of its measures."""

    def one(w: Column) -> Column:
        end = w["start"] + w["size"]
        return F.struct(w["word"].alias("word"), w["start"].alias("start"), end.alias("end"), *[traces.mean(_part(F.col(m), w["start"], end)).alias(m) for m in measures])

    return rows.withColumn("_ws", traces.words(F.col("text"))).withColumn("ws", F.transform("_ws", one)).drop("_ws")


def _joined(t: Column, start: Column, end: Column) -> Column:
    left, right = F.substring(t, F.lit(1), start.cast("int")), F.substr(t, (end + 1).cast("int"))
    a, b = F.regexp_replace(left, r"\s+$", ""), F.regexp_replace(right, r"^\s+", "")
    apart = F.regexp_like(left, F.lit(r"\s$")) | F.regexp_like(right, F.lit(r"^\s")) | (F.regexp_like(left, F.lit(r"[\p{L}\p{N})\]}]$")) & F.regexp_like(right, F.lit(r"^[\p{L}\p{N}(\[{]")))
    return F.trim(F.regexp_replace(F.concat(a, F.when(apart, F.lit(" ")).otherwise(F.lit("")), b), r"\s+", " "))


def without(t: Column, start: Column, end: Column) -> Column:
    """A text without a span; its sides are joined as they were apart, and words and brackets never grow together."""
    return T.composed(_joined(t, start, end))


def expanded(rows: DataFrame, most: int = 2, prefix: int = 8) -> DataFrame:
    """rows (p_floor, s_floor, last_ink, start) with start moved back over up to `most` words that stand in the same place
    of the image and are weak there, and with taken, their number. Words with digits stay."""
    out = rows.withColumn("taken", F.lit(0).cast("long"))
    for k in range(most):
        stem = F.regexp_replace(F.substring("text", F.lit(1), F.col("start").cast("int")), r"[^\p{L}\p{N}_]+$", "")
        out = out.withColumn("_stem", stem).withColumn("_word", F.regexp_extract("_stem", f"{WORD}+$", 0))
        out = out.withColumn("_end", F.length("_stem")).withColumn("_from", F.col("_end") - F.length("_word"))
        start, end, n = F.col("_from"), F.col("_end"), F.size("c")
        word = {m: traces.mean(_part(F.col(m), start, end)) for m in MEASURES}
        before = {m: _median(_part(F.col(m), F.lit(0), start)) for m in ("p", "s")}
        out = out.withColumns({f"_{m}": v for m, v in word.items()}).withColumns({f"_old_{m}": v for m, v in before.items()})
        tail = traces.mean(_part(F.col("c"), F.col("start").cast("int"), n))
        near = (F.abs(F.col("_c") - tail) <= 0.08) & (traces.spread(_part(F.col("c"), start, n)) <= 0.12) & (F.col("_c") >= F.col("last_ink") - 0.10)
        weak = F.col("_s") <= F.least(F.lit(0.16), F.greatest(F.col("s_floor"), 0.35 * F.col("_old_s")))
        doubtful = (F.col("_p") <= F.least(F.lit(0.82), F.greatest(F.col("p_floor") + 0.12, 0.90 * F.col("_old_p")))) | (F.col("_s") <= 0.55 * F.col("s_floor"))
        # the words taken so far must follow one another: a word that stays ends the walk
        go = (F.col("taken") == k) & (F.col("_word") != "") & ~_has_digit(F.col("_word")) & (start >= prefix) & near & weak & doubtful
        out = out.withColumn("_go", F.coalesce(go, F.lit(False)))
        out = out.withColumns({"start": F.when(F.col("_go"), F.col("_from").cast("long")).otherwise(F.col("start")), "taken": F.col("taken") + F.col("_go").cast("long")})
        out = out.drop("_stem", "_word", "_end", "_from", "_go", *[f"_{m}" for m in MEASURES], "_old_p", "_old_s")
    return out


def amid(rows: DataFrame, prefix: int = 8, suffix: int = 6, most: int = 12, share: float = 0.55, anchor: int = 2) -> DataFrame:
    """rows (p_floor, s_floor) with span: the run of weak words, between two anchors that are borne out, that its attention
    does not move over though it goes on behind. Of several the one with the highest score, the first of equals; null
    without one."""
    out = words(rows).withColumn("_n", F.size("ws"))
    p_most, s_most = F.least(F.lit(0.72), F.col("p_floor") + 0.10), F.least(F.lit(0.18), 1.25 * F.col("s_floor"))
    out = out.withColumn("_strong", F.filter(F.transform("ws", lambda w, i: F.when((w["p"] > p_most) | (w["s"] > s_most), i)), lambda x: x.isNotNull()))
    # a run lies between two strong words that follow one another in the list
    gaps = F.transform(F.slice("_strong", F.lit(1), F.greatest(F.size("_strong") - 1, F.lit(0))), lambda x, i: F.struct((x + 1).alias("first"), F.get("_strong", i + 1).alias("last")))
    out = out.withColumn("_runs", F.filter(gaps, lambda r: (r["last"] > r["first"]) & (r["last"] - r["first"] <= most)))

    def measured(r: Column) -> Column:
        first, last = r["first"], r["last"]
        parts = {"own": F.slice("ws", first + 1, last - first), "left": F.slice("ws", F.greatest(first - anchor, F.lit(0)) + 1, F.least(first, F.lit(anchor))), "right": F.slice("ws", last + 1, F.least(F.lit(anchor), F.col("_n") - last))}
        means = [F.struct(*[_mean_of(ws, m).alias(m) for m in MEASURES]).alias(k) for k, ws in parts.items()]
        start, end = F.get("ws", first)["start"], F.get("ws", last - 1)["end"]
        c = _part(F.col("c"), start, end)
        return F.struct(start.alias("start"), end.alias("end"), first.alias("first"), *means, traces.spread(c).alias("range"), (F.element_at(c, -1) - F.element_at(c, 1)).alias("progress"))

    out = out.withColumn("_spans", F.transform("_runs", measured))

    def fits(x: Column) -> Column:
        own, left, right, size = x["own"], x["left"], x["right"], F.length("text")
        room = (x["start"] >= prefix) & (size - x["end"] >= suffix) & ((x["end"] - x["start"]) / size <= share)
        borne = F.lit(True)
        for side in (left, right):
            borne = borne & (side["p"] >= F.greatest(F.col("p_floor"), 1.2 * own["p"])) & (side["s"] >= F.greatest(F.col("s_floor"), 1.8 * own["s"]))
        back = F.least(F.abs(own["c"] - left["c"]), F.abs(own["c"] - right["c"]))
        still = ((x["range"] <= 0.12) | (F.abs(x["progress"]) <= 0.04)) & ((back <= 0.10) | (right["c"] - own["c"] >= 0.05))
        onward = (right["c"] - left["c"] >= 0.08) & (right["c"] >= own["c"] - 0.10)
        alone = (own["s"] <= 0.55 * F.least(left["s"], right["s"])) & (own["p"] <= 0.82 * F.least(left["p"], right["p"]))
        return room & borne & still & onward & alone & (F.length(_joined(F.col("text"), x["start"], x["end"])) >= prefix)

    def scored(x: Column) -> Column:
        own, left, right = x["own"], x["left"], x["right"]
        score = F.least(left["s"], right["s"]) - own["s"] + F.least(left["p"], right["p"]) - own["p"] + F.greatest(F.lit(0.0), right["c"] - left["c"]) + F.greatest(F.lit(0.0), right["c"] - own["c"]) - x["range"]
        return F.struct(score.alias("score"), (-x["first"]).alias("back"), x["start"].alias("start"), x["end"].alias("end"))

    out = settled(out, "span", F.array_max(F.transform(F.filter("_spans", fits), scored)))
    return out.drop("ws", "_n", "_strong", "_runs", "_spans")


def cuts(rows: DataFrame, prefix: int = 8, least: int = 3) -> DataFrame:
    """rows (text, p, c, s, last_ink, near_loop) with reason, kind (suffix or midline), start, end, taken, kept (the text
    that stays), removed and numeric (a number would go: a warning, not a change). An end without ground goes with the
    words of its cluster; where none goes, a span amid the line may. All null where nothing does."""
    out = evidence.decide(aligned(rows), least=least, prefix=prefix).withColumn("_own", F.col("start"))
    clusters = F.col("reason").isin("visual_evidence_exhausted", "attention_stall")
    moved = expanded(out, prefix=prefix)
    moved = moved.withColumns({"start": F.when(clusters, F.col("start")).otherwise(F.col("_own")), "taken": F.when(clusters, F.col("taken")).otherwise(F.lit(0).cast("long"))})
    head = F.regexp_replace(F.substring("text", F.lit(1), F.col("start").cast("int")), r"\s+$", "")
    moved = moved.withColumns({"_head": head, "_gone": T.strip(F.substr("text", (F.col("start") + 1).cast("int")))})
    ends = (F.length("_head") >= prefix) & (F.col("_gone") != "") & F.col("reason").isNotNull()
    moved = amid(moved.withColumn("_ends", F.coalesce(ends, F.lit(False))), prefix=prefix)
    inside = ~F.col("_ends") & F.col("span").isNotNull() & (F.length("text") >= prefix + least)
    a, b = F.col("span.start"), F.col("span.end")
    pick = lambda suffix, mid: F.when(F.col("_ends"), suffix).when(inside, mid)
    own = F.substring("text", a + 1, b - a)
    result = {
        "reason": pick(F.col("reason"), F.lit("unsupported_midline_span")), "kind": pick(F.lit("suffix"), F.lit("midline")), "start": pick(F.length("_head").cast("long"), a.cast("long")),
        "end": pick(F.length("text").cast("long"), b.cast("long")), "taken": pick(F.col("taken"), F.lit(0).cast("long")), "kept": pick(T.normalized(F.col("_head")), without(F.col("text"), a, b)),
        "removed": pick(F.col("_gone"), own), "numeric": pick(_has_digit(F.col("_gone")), _has_digit(own)),
    }
    moved = settled(moved, "_cut", F.struct(*[v.alias(k) for k, v in result.items()]))
    return moved.withColumns({k: F.col(f"_cut.{k}") for k in result}).drop("_cut", "_own", "_head", "_gone", "_ends", "span", "p_floor", "s_floor")
