"""Quality rules as a learned decision list over document statistics.

Sequential covering: a rule is a conjunction of thresholds on statistics that rejects a document. Rules grow on two
thirds of the labelled rows by information gain, are pruned on the other third, and are accepted only when that third
confirms them; the rows a rule covers leave, and the next rule is grown. The list becomes one ordered Spark conditional
expression. Growing reads counts per (statistic, threshold bin), made by Spark from all labelled rows; the driver sees
these counts only, never rows.

Only DataFrame operations. Statistics are local to a row; scoring never shuffles.

Defined results: null and empty texts have zero words and fail the base rule; null statistics do not occur; labels of
null, unknown or repeated ids join as they are (no match, or one training row per match); without labels the list is
empty and the base rule alone decides; extra columns of ``docs`` are passed through.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrid.llm.common import split_words, text_of
from pagegrid.plans.lineage import cut

#: characters that count as symbols (fixed by the contract)
SYMBOLS = "#*$%&|<>"
#: blanks between words (fixed by the contract)
_BLANK_CHARS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.statistic) > self.threshold if self.above else F.col(self.statistic) <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        found = F.lit(True)
        for c in self.conditions:
            found = found & c.column()
        return found

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass
class DecisionList:
    """Ordered rules; the first that matches rejects, none keeps."""

    rules: list[Rule] = field(default_factory=list)

    def rule_number(self) -> Column:
        """1-based number of the deciding rule, 0 where none matches."""
        chosen = F.lit(0)
        for i in range(len(self.rules), 0, -1):
            chosen = F.when(self.rules[i - 1].column(), F.lit(i)).otherwise(chosen)
        return chosen


def with_repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds ``out``: words inside three-word windows that occur twice or more in the text, the first included.

    Windows are sorted inside the row, so repeats are neighbours. Each array is a column of its own: an expression that
    stands inside a lambda is computed again for every element.
    """
    hashes, placed = f"{out}_hashes", f"{out}_placed"
    w = F.col(words)

    def windows(make) -> Column:
        return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: make(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    # hashes tell cheaply that a text has no repeats; where they find some, the words themselves decide
    df = df.withColumn(hashes, windows(F.xxhash64))
    repeats = F.size(F.array_distinct(F.col(hashes))) < F.size(F.col(hashes))
    grams = windows(lambda *x: F.concat_ws(" ", *x))
    df = df.withColumn(placed, F.when(repeats, F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    p = F.col(placed)
    twice = F.filter(p, lambda x, k: (F.get(p, k - 1)["g"] == x["g"]) | (F.get(p, k + 1)["g"] == x["g"]))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return df.withColumn(out, F.when(p.isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long")).drop(hashes, placed)


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds the base statistics and the ratios rules are grown on. Names get ``prefix``."""
    text = text_of(F.col(text_col))
    w, ln = f"{prefix}words", f"{prefix}lines"
    split = docs.withColumns({w: split_words(text), ln: F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _BLANK_CHARS, "")) > 0)})
    chars = F.char_length(text)

    def dropped(pattern: str) -> Column:
        return (chars - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")

    p = prefix
    counted = with_repeat_words(split, w, f"{p}n_repeat_words").withColumns({
        f"{p}n_words": F.size(w).cast("long"),
        f"{p}word_chars": F.aggregate(F.col(w), F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)),
        f"{p}n_symbols": dropped(r"[#*$%&|<>]+"),
        f"{p}n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
        f"{p}n_lines": F.size(ln).cast("long"),
        f"{p}n_upper": dropped(r"[A-Z]+"),
        f"{p}n_marks": dropped(r"[!-/:-@\[-`{-~]+"),
        f"{p}n_digits": dropped(r"[0-9]+"),
    }).drop(w, ln)
    return with_ratios(counted, prefix)


def with_ratios(counted: DataFrame, prefix: str = "") -> DataFrame:
    c = lambda n: F.col(f"{prefix}{n}")
    words, chars, lines = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1)), F.greatest(c("n_lines"), F.lit(1))
    return counted.withColumns({
        f"{prefix}r_symbols": c("n_symbols") / words, f"{prefix}r_mean_word": c("word_chars") / words, f"{prefix}r_dup_lines": c("n_dup_lines") / lines,
        f"{prefix}r_repeat": c("n_repeat_words") / words, f"{prefix}r_upper": c("n_upper") / chars, f"{prefix}r_marks": c("n_marks") / words,
        f"{prefix}r_digits": c("n_digits") / chars,
    })


#: statistics that rules may test
FEATURES = ["r_symbols", "r_mean_word", "r_dup_lines", "r_repeat", "r_upper", "r_marks", "r_digits"]


def base_failed(prefix: str = "") -> Column:
    words = F.col(f"{prefix}n_words")
    return (words < 50) | (F.lit(100) * F.col(f"{prefix}n_repeat_words") > F.lit(50) * words)


def _entropy_gain(p0: float, n0: float, p1: float, n1: float) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else float("-inf")


def learn(
    stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", features: list[str] | None = None,
    bins: int = 32, max_rules: int = 12, max_conditions: int = 3, precision: float = 0.97, least: int = 5,
) -> DecisionList:
    """Grows the list on all labelled rows of ``stats`` (label 0 is what rules reject).

    ``bins`` thresholds per statistic and class come from quantiles. A rule needs ``precision`` and ``least`` rejected
    rows on the growing and, for its precision, on the pruning rows.
    """
    features = features or FEATURES
    named = stats.select(F.col(id_col).alias("_id"), *features)
    given = labels.select(F.col(id_col).alias("_id"), (F.col(label_col) == 0).cast("int").alias("_bad")).where("_bad is not null")
    rows = named.join(given, "_id").withColumn("_prune", (F.pmod(F.xxhash64("_id", *features), F.lit(3)) == 0).cast("int"))
    quantiles = [i / bins for i in range(1, bins)]
    rows = cut(rows.drop("_id"))
    cuts: dict[str, set[float]] = {f: set() for f in features}
    for row in rows.groupBy("_bad").agg(*[F.percentile_approx(f, quantiles, 2000).alias(f) for f in features]).collect():
        for f in features:
            cuts[f].update(row[f] or ())
    thresholds = {f: sorted(v) for f, v in cuts.items()}
    if not any(thresholds.values()):
        return DecisionList()
    def bin_of(f: str) -> Column:
        listed = F.array(*[F.lit(float(t)) for t in thresholds[f]]).cast("array<double>")
        return F.size(F.filter(listed, lambda t: t < F.col(f))).alias(f)

    binned = [bin_of(f) for f in features]
    # rows with the same bins are one cell with a weight
    cells = cut(rows.select("_bad", "_prune", *binned).groupBy("_bad", "_prune", *features).agg(F.count("*").alias("_n")).coalesce(8))

    def counts(active: Column) -> dict[str, list[list[list[int]]]]:
        """Per statistic and bin: [grow, prune] x [good, bad]."""
        table = {f: [[[0, 0], [0, 0]] for _ in range(len(thresholds[f]) + 1)] for f in features}
        stacked = cells.where(active).select("_bad", "_prune", "_n", F.posexplode(F.array(*features)).alias("_f", "_bin"))
        for r in stacked.groupBy("_f", "_bin", "_prune", "_bad").agg(F.sum("_n").alias("n")).collect():
            table[features[r["_f"]]][r["_bin"]][r["_prune"]][r["_bad"]] += r["n"]
        return table

    def binned_column(c: tuple[str, bool, int]) -> Column:
        return F.col(c[0]) > c[2] if c[1] else F.col(c[0]) <= c[2]

    def confirmed(grow_bad: int, grow_good: int, prune_bad: int, prune_good: int) -> bool:
        return grow_bad >= least and prune_bad > 0 and grow_bad >= precision * (grow_bad + grow_good) and prune_bad >= precision * (prune_bad + prune_good)

    def grow(remaining: Column) -> list[tuple[str, bool, int]]:
        """Conditions of the next rule, pruned; none when the pruning rows confirm no rule.

        A step adds the condition with the best information gain. As soon as some condition would make the rule precise
        enough on both sets, the one of these that covers most ends it.
        """
        chosen: list[tuple[str, bool, int]] = []
        active = remaining
        for _ in range(max_conditions):
            table = counts(active)
            total = [[sum(b[s][k] for b in table[features[0]]) for k in (0, 1)] for s in (0, 1)]
            if not total[0][1]:
                return []
            done, done_cover, best, gain = None, 0, None, 1e-9
            for f in features:
                low = [[0, 0], [0, 0]]
                for i in range(len(thresholds[f])):
                    low = [[low[s][k] + table[f][i][s][k] for k in (0, 1)] for s in (0, 1)]
                    for above in (True, False):
                        (gn, gp), (pn, pp) = [[total[s][k] - low[s][k] if above else low[s][k] for k in (0, 1)] for s in (0, 1)]
                        if confirmed(gp, gn, pp, pn) and gp + pp - gn - pn > done_cover:
                            done, done_cover = (f, above, i), gp + pp - gn - pn
                        if gp >= least and (g := _entropy_gain(*total[0][::-1], gp, gn)) > gain:
                            best, gain = (f, above, i), g
            if done is not None:
                return [*chosen, done]
            if best is None:
                return []
            chosen.append(best)
            active = active & binned_column(best)
        return []

    rules: list[Rule] = []
    remaining = F.lit(True)
    while len(rules) < max_rules:
        conditions = grow(remaining)
        if not conditions:
            break
        rules.append(Rule(tuple(Condition(f, above, float(thresholds[f][i])) for f, above, i in conditions)))
        matched = F.lit(True)
        for c in conditions:
            matched = matched & binned_column(c)
        remaining = remaining & ~matched
    return DecisionList(rules)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, statistics, base_failed, rule (number of the rule that rejects, else 0), kept."""
    stats = cut(with_statistics(docs.select(F.col(id_col), F.col(text_col)), text_col).drop(text_col))
    rules = learn(stats, labels, id_col, **options)
    return stats.withColumns({"base_failed": base_failed(), "rule": rules.rule_number()}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    decided = with_statistics(docs.select(F.struct("*").alias("doc"), F.col(id_col), F.col(text_col)), text_col)
    rules = learn(decided.drop("doc", text_col), labels, id_col, **options)
    # a filter would be pushed below the statistics and repeat them inside their own lambdas; a generator is not moved
    kept = F.when(~base_failed() & (rules.rule_number() == 0), F.array(F.lit(1)))
    return decided.select("doc", F.explode(kept).alias("kept")).select("doc.*")
