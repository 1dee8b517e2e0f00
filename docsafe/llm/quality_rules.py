"""Quality rules as learned decision lists; DataFrame functions only.

`statistics` measures whole texts. `learn` covers the labelled poor rows sequentially: a rule is a conjunction of
thresholds, grown one condition at a time by information gain on the growing rows, then pruned from its end on the
others; the rows it takes leave, and the next rule is grown. Every step is one aggregation over histograms of a fixed
threshold grid, so what reaches the driver has as many rows as the grid. `verdict` writes the list as one ordered
CASE expression. A list has at most `most_rules` rules of `most_conditions` conditions each, parameters of `learn` that
keep it readable; learning ends before where no further rule is precise enough.

Defined cases: a null or empty text has no words (every count 0); a text of any length is measured whole within its
row; repeated doc_ids are separate rows; a null label or doc_id trains nothing, contradicting labels of a document
count by their mean; without labelled rows of both kinds the list is empty and nothing is rejected; extra columns
of the input pass through `decide` unless a statistic has the same name, which then replaces it. Rows of one doc_id train as
one, by the least of each feature.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsafe.llm import _shared

SPACE = " \t\n\x0b\f\r"
RATIOS = (0.0, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0, 3.0)
LENGTHS = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0)

#: Thresholds tried for each feature.
GRID = {
    "mean_word_chars": LENGTHS,
    "symbols_per_word": RATIOS,
    "dup_line_ratio": RATIOS,
    "repeat_ratio": RATIOS,
    "upper_ratio": RATIOS,
    "bang_per_word": RATIOS,
}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words and the features of GRID."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda c, chars: F.regexp_count(c, F.lit(chars)).cast("long")
    df = docs.withColumn("_t", t).drop(text).withColumn("_c", F.btrim("_t", F.lit(SPACE)))
    df = df.withColumns({
        "_w": F.when(F.col("_c") == "", F.array().cast("array<string>")).otherwise(F.split("_c", f"[{SPACE}]+")),
        "_l": F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
        "n_symbols": count(F.col("_t"), "[#*$%&|<>]"),
        "_up": count(F.col("_t"), "[A-Z]"),
        "_bang": count(F.col("_t"), "!"),
    }).drop("_t", "_c")
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_lines": F.size("_l"),
    }).drop("_l")
    # hash and place of every window share a long, so that equal windows meet in a sort of longs; at most the low bits
    # hold the place. Windows whose hash occurs once cannot repeat; the others are then compared by their words.
    bits = F.when(F.col("n_words") < 1 << 20, F.lit(20)).otherwise(F.lit(31))
    word = lambda i: F.get(F.col("_w"), i)
    packed = F.transform("_w", lambda x, i: F.expr("1L") * i + F.call_function("shiftleft", F.xxhash64(x, word(i + 1), word(i + 2)), F.col("_bits")))
    df = df.withColumn("_bits", bits)
    df = df.withColumn("_h", F.sort_array(F.slice(packed, 1, F.greatest(F.size("_w") - 2, F.lit(0)))))
    high = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    near = lambda x, at: F.coalesce(high(F.get(F.col("_h"), at)) == high(x), F.lit(False))
    df = df.withColumn("_h", F.filter("_h", lambda x, k: near(x, k - 1) | near(x, k + 1)))
    place = lambda x: (x - F.call_function("shiftleft", high(x), F.col("_bits"))).cast("int")
    window = lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("g"), i.alias("i"))
    df = df.withColumn("_s", F.sort_array(F.transform("_h", lambda x: window(place(x))))).drop("_w", "_h", "_bits")
    same = lambda x, at: F.coalesce(F.get(F.col("_s"), at)["g"] == x["g"], F.lit(False))
    again = F.filter("_s", lambda x, k: same(x, k - 1) | same(x, k + 1))
    df = df.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_s")
    # each repeated window adds its words up to the next repeated window's start, three at most
    reach = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.aggregate(reach, F.lit(0).cast("long"), lambda s, x: s + x)).drop("_p")
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns({
        "mean_word_chars": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "_lines"), "repeat_ratio": per("n_repeat_words", "n_words"),
        "upper_ratio": per("_up", "word_chars"), "bang_per_word": per("_bang", "n_words"),
    }).drop("_up", "_bang", "_lines")


#: Columns that the statistics and the decision add.
MADE = {"n_symbols", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept", *GRID}


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words", least: int = 50, percent: int = 50) -> Column:
    return (F.col(n_words) < least) | (100 * F.col(n_repeat_words) > percent * F.col(n_words))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def binned(self) -> Column:
        """The same of a row of bins: how many thresholds of the grid the feature exceeds."""
        at = GRID[self.feature].index(self.threshold)
        return F.col(self.feature) > at if self.above else F.col(self.feature) <= at

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self, binned: bool = False) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & (c.binned() if binned else c.column())
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def verdict(self) -> Column:
        """The name of the first rule that holds; null where none does."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            out = F.when(rule.column(), F.lit(str(rule))).otherwise(out)
        return out


def _counts(rows: DataFrame, where: Column) -> dict[Condition, tuple[int, int]]:
    """For every condition of the grid: the poor and the good rows that it holds for. One aggregation."""
    pairs = [F.struct(F.lit(name).alias("f"), F.col(name).alias("bin")) for name in GRID]
    found = rows.where(where).select("poor", "n", F.explode(F.array(*pairs)).alias("x")).groupBy("x.f", "x.bin").agg(F.sum(F.col("poor") * F.col("n")).alias("p"), F.sum("n").alias("n")).collect()
    cells = {(r["f"], r["bin"]): (int(r["p"]), int(r["n"]) - int(r["p"])) for r in found}
    out = {}
    for name, grid in GRID.items():
        bins = [cells.get((name, b), (0, 0)) for b in range(len(grid) + 1)]
        for i, t in enumerate(grid):
            low, high = bins[: i + 1], bins[i + 1 :]
            out[Condition(name, True, t)] = (sum(x[0] for x in high), sum(x[1] for x in high))
            out[Condition(name, False, t)] = (sum(x[0] for x in low), sum(x[1] for x in low))
    return out


def _purity(p: float, n: float) -> float:
    return math.log2((p + 1e-9) / (p + n + 1e-9) + 1e-9)


def learn(labelled: DataFrame, most_rules: int = 6, most_conditions: int = 3, precision: float = 0.97, least: int = 5) -> DecisionList:
    """labelled: doc_id, quality (0 poor, 1 good) and the features. A third of the rows, by hash of doc_id, prunes.

    A rule stays if on the growing and the pruning rows together it is right at least `precision` of the time and
    takes at least `least` poor rows.
    """
    rows = labelled.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"), *[F.min(f).alias(f) for f in GRID])
    # from here on a row is a combination of bins and its count: conditions of the grid tell no more apart
    bins = [sum((F.col(name) > t).cast("int") for t in grid).alias(name) for name, grid in GRID.items()]
    rows = rows.select((F.col("q") < 0.5).cast("int").alias("poor"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), *bins)
    rows = _shared.written(rows.groupBy("poor", "prune", *GRID).agg(F.count("*").alias("n")), "labelled")
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < most_rules:
        grow, held, total = left & ~F.col("prune"), [], None
        while len(held) < most_conditions:
            inside = grow
            for c in held:
                inside = inside & c.binned()
            counts = _counts(rows, inside)
            # any threshold and its reverse split all rows that are left
            any_feature = next(iter(GRID))
            here = tuple(map(sum, zip(counts[Condition(any_feature, True, GRID[any_feature][0])], counts[Condition(any_feature, False, GRID[any_feature][0])], strict=True)))
            total = total or here
            if here[0] < least or here[1] == 0:
                break
            base = _purity(*here)
            gain = {c: p * (_purity(p, n) - base) for c, (p, n) in counts.items() if p >= least}
            best = max(gain, key=lambda c: (gain[c], c.feature, c.above, -c.threshold), default=None)
            if best is None or gain[best] <= 1e-9:
                break
            # thresholds that take the same rows tie: the middle one keeps the widest margin on both sides
            ties = sorted((c for c in gain if (c.feature, c.above) == (best.feature, best.above) and counts[c] == counts[best]), key=lambda c: c.threshold)
            held.append(ties[len(ties) // 2])
        if not held:
            break
        # one aggregation judges every prefix of the rule on both parts
        prefixes = [Rule(tuple(held[:k])) for k in range(len(held), 0, -1)]
        seen = rows.where(left).agg(*[F.coalesce(F.sum(F.when(r.column(True) & side & (F.col("poor") == v), F.col("n"))), F.lit(0)).alias(f"{k}_{s}_{v}") for k, r in enumerate(prefixes) for s, side in (("g", ~F.col("prune")), ("t", F.col("prune"))) for v in (0, 1)]).first()
        worth = {}
        for k, r in enumerate(prefixes):
            p, n = seen[f"{k}_t_1"], seen[f"{k}_t_0"]
            worth[r] = (p - n) / (p + n) if p + n else -1.0
        best_rule = max(prefixes, key=lambda r: (worth[r], -len(r.conditions)))
        k = prefixes.index(best_rule)
        p, n = seen[f"{k}_g_1"] + seen[f"{k}_t_1"], seen[f"{k}_g_0"] + seen[f"{k}_t_0"]
        if p < least or p < precision * (p + n):
            if len(best_rule.conditions) < len(held):  # the whole conjunction may still be precise enough
                best_rule, k = prefixes[0], 0
                p, n = seen["0_g_1"] + seen["0_t_1"], seen["0_g_0"] + seen["0_t_0"]
            if p < least or p < precision * (p + n):
                break
        rules.append(best_rule)
        left = left & ~best_rule.column(True)
    return DecisionList(tuple(rules))


def decide(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple[DataFrame, DecisionList]:
    """Statistics of every document with base_failed, rejected_by (a rule's text or null) and kept; and the list."""
    kept = [c for c in docs.columns if c == text or c not in MADE]
    passed = docs.select(*[F.col(f"`{c}`").alias(c if c == text else f"x{i}") for i, c in enumerate(kept)])
    stats = statistics(passed, text)
    named = {f"x{i}": c for i, c in enumerate(kept) if c != text}
    stats = _shared.written(stats.select(*[F.col(c).alias(named.get(c, c)) for c in stats.columns]), "statistics")
    marks = labels.select(F.col("doc_id"), F.col("quality"))
    found = learn(stats.select("doc_id", *GRID).join(marks, "doc_id"))
    out = stats.withColumns({"base_failed": base_failed(), "rejected_by": found.verdict()})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()), found


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out, _ = decide(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
