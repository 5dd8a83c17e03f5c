"""Quality rules: an ordered list of threshold conditions, learned from labelled documents.

Method: every text is measured by built-in functions alone. Sequential covering then finds
one rule after another among labelled rows that no earlier rule covers: a rule grows by the
condition with the largest gain of information about the label 0, and loses its last
conditions again where other rows say so (pruning). The counts behind each step are one
small table, number by statistic and bin. The rules become one conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvebeacon.llm.common import scratch

_SPACE = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "[#*$%&|<>]"
_WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """``rows``: labelled rows to learn from, about; ``right``: least share of rightly rejected rows."""

    rows: int = 20_000
    bins: int = 24
    conditions: int = 4
    rules: int = 16
    right: float = 0.9
    support: int = 3
    shortest: int = 10
    repeated: int = 20


@dataclass(frozen=True)
class Condition:
    """A statistic at or above a limit, or below it."""

    name: str
    above: bool
    limit: float

    def column(self) -> Column:
        return F.col(self.name) >= self.limit if self.above else F.col(self.name) < self.limit

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.limit:.6g}"


Rule = tuple[Condition, ...]


# ---- statistics ---------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """The body with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _windows(hashes: Column) -> Column:
    """A hash of each run of five words."""
    starts = F.sequence(F.lit(0), F.size(hashes) - _WINDOW)
    found = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(_WINDOW)]))
    return F.when(F.size(hashes) >= _WINDOW, found).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more.

    Sorted by hash, equal windows are neighbours. Their places in order each add
    the words up to the next such place, five at most.
    """

    def places(ordered: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            same = F.get(ordered, i + 1)["h"] == x["h"]
            return F.coalesce(same, F.lit(False)) | F.coalesce(
                (i > 0) & (F.get(ordered, i - 1)["h"] == x["h"]), F.lit(False)
            )

        return F.sort_array(F.transform(F.filter(ordered, again), lambda x: x["p"]))

    def added(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(_WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(_WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    numbered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    found = _let(F.transform(F.array(numbered), places)[0], added)
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), found).otherwise(0)


def _share(part: Column, whole: str) -> Column:
    return part / F.greatest(F.col(whole), F.lit(1))


#: Statistics that rules may use, each a number per document.
STATISTICS = {
    "n_words": F.col,
    "mean_word": lambda _: _share(F.col("word_chars"), "n_words"),
    "symbol_share": lambda _: _share(F.col("n_symbols"), "n_words"),
    "repeat_share": lambda _: _share(F.col("n_repeat_words"), "n_words"),
    "duplicate_line_share": lambda _: _share(F.col("n_dup_lines"), "n_lines"),
    # Long texts repeat words more often; this power of the length hardly changes with it.
    "distinct_power": lambda _: F.when(
        F.col("n_words") > 1, F.log(F.greatest("n_distinct", F.lit(1))) / F.log("n_words")
    ).otherwise(1.0),
    "words_per_line": lambda _: _share(F.col("n_words"), "n_lines"),
    "upper_share": lambda _: _share(F.col("n_upper"), "word_chars"),
    "digit_share": lambda _: _share(F.col("n_digits"), "word_chars"),
    "mark_share": lambda _: _share(F.col("n_marks"), "n_words"),
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares of rules."""

    def number(signs: str) -> Column:
        return F.regexp_count("__text", F.lit(signs)).cast("long")

    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")
    )
    words = texts.select(
        "*",
        F.array_remove(F.split("__text", _SPACE), "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]"))).alias("__lines"),
    )
    counted = words.select(
        "doc_id",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        number(_SYMBOLS).alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("__words")).cast("long").alias("n_distinct"),
        number("\\p{Lu}").alias("n_upper"),
        number("[0-9]").alias("n_digits"),
        number("[.,;:?!]").alias("n_marks"),
        _let(
            F.transform("__words", lambda w: F.xxhash64(w)), lambda hashes: _let(_windows(hashes), _covered)
        ).cast("long").alias("n_repeat_words"),
    )
    return counted.select("*", *[f(n).alias(n) for n, f in STATISTICS.items() if n not in counted.columns])


# ---- learning -------------------------------------------------------------------


def _limits(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Limits of each statistic: quantiles of all rows and of the rows to reject."""
    steps = [i / bins for i in range(bins)]
    asked = []
    for name in STATISTICS:
        value = F.col(name).cast("double")
        asked.append(F.percentile_approx(value, steps).alias(name))
        asked.append(F.percentile_approx(F.when(F.col("bad") == 1, value), steps).alias(f"{name}_bad"))
    found = rows.agg(*asked).first()
    return {n: sorted({*(found[n] or []), *(found[f"{n}_bad"] or [])}) for n in STATISTICS}


def _all_of(rule: list[tuple[str, bool, int]]) -> Column:
    """The binned form of a rule; an empty one covers every row."""
    parts = [F.col(name) >= k if above else F.col(name) < k for name, above, k in rule]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _counts(rows: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """Rows to reject and to keep by statistic and bin."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in STATISTICS])
    found = rows.select("bad", F.inline(cells)).groupBy("name", "bin").agg(
        F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("q")
    )
    return {(r["name"], r["bin"]): (r["p"], r["q"]) for r in found.collect()}


def _best(
    counts: dict[tuple[str, int], tuple[int, int]], limits: dict[str, list[float]]
) -> tuple[float, int, tuple[str, bool, int]] | None:
    """Gain, wrongly covered rows and the condition of the largest gain; first by name on ties."""
    best = None
    for name, cuts in limits.items():
        p = [counts.get((name, k), (0, 0))[0] for k in range(len(cuts) + 1)]
        q = [counts.get((name, k), (0, 0))[1] for k in range(len(cuts) + 1)]
        everything = sum(p) + sum(q)
        if not sum(p):
            return None
        before = math.log2(sum(p) / everything)
        for k in range(1, len(cuts) + 1):
            for above, right, wrong in ((True, sum(p[k:]), sum(q[k:])), (False, sum(p[:k]), sum(q[:k]))):
                if right and right + wrong < everything:
                    gain = right * (math.log2(right / (right + wrong)) - before)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, wrong, (name, above, k)
    return best


def learn(labelled: DataFrame, how: Rules = Rules()) -> list[Rule]:
    """The rules, in order, from rows with the statistics, ``bad`` (0 or 1) and ``fold``.

    Rows of fold 0 prune, the others grow. A rule is taken when at least ``right``
    of the rows it covers, and ``support`` of them, are bad. Without rows of both
    kinds there are no rules.
    """
    limits = _limits(labelled.where("fold <> 0"), how.bins)
    with scratch(labelled.sparkSession, "rules") as work:
        numbers = [
            # Number of limits at or below the value.
            reduce(lambda a, b: a + b, [(F.col(n) >= x).cast("int") for x in cuts], F.lit(0)).alias(n)
            for n, cuts in limits.items()
        ]
        left = work.table(labelled.select("bad", "fold", *numbers).coalesce(4), "bins")
        found: list[Rule] = []
        while len(found) < how.rules:
            rule: list[tuple[str, bool, int]] = []
            while len(rule) < how.conditions:
                best = _best(_counts(left.where("fold <> 0").where(_all_of(rule))), limits)
                if best is None:
                    break
                rule.append(best[2])
                if best[1] == 0:
                    break
            if not rule:
                break
            kept = _prune(left, rule, how)
            if not kept:
                break
            found.append(tuple(Condition(n, above, limits[n][k - 1]) for n, above, k in kept))
            left = left.where(~_all_of(kept))
        return found


def _prune(left: DataFrame, rule: list[tuple[str, bool, int]], how: Rules) -> list[tuple[str, bool, int]]:
    """The beginning of the rule that serves the pruning rows best; empty if none is right enough."""
    asked = []
    for k in range(1, len(rule) + 1):
        for part, rows in (("all", F.lit(True)), ("prune", F.col("fold") == 0)):
            covered = _all_of(rule[:k]) & rows
            asked.append(F.coalesce(F.sum(F.when(covered, F.col("bad"))), F.lit(0)).alias(f"p_{part}_{k}"))
            asked.append(F.count_if(covered).alias(f"n_{part}_{k}"))
    seen = left.agg(*asked).first()
    best, value = [], -math.inf
    for k in range(1, len(rule) + 1):
        p, n = seen[f"p_all_{k}"], seen[f"n_all_{k}"]
        if p < how.support or p < how.right * n:
            continue
        right, covered = seen[f"p_prune_{k}"], seen[f"n_prune_{k}"]
        worth = (2 * right - covered) / covered if covered else -1.0
        if worth > value:
            best, value = rule[:k], worth
    return best


def rule_number(rules: list[Rule]) -> Column:
    """The first rule that holds, from 1; 0 if none does."""
    branch = F
    for i, rule in enumerate(rules, 1):
        branch = branch.when(reduce(lambda a, b: a & b, [c.column() for c in rule]), F.lit(i))
    return branch.otherwise(0) if rules else F.lit(0)


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    how: Rules = Rules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """One row per document: doc_id, n_words, the four counts, base_failed, kept, rule, rule_text, held_out.

    Rules are learned from about ``rows`` labelled documents whose crc32(doc_id as
    text) mod 5 is not 0; ids whose labels differ or are null teach nothing. ``rule``
    is the number of the first rule that rejects a document (0: none), ``rule_text``
    its conditions. A null text is an empty one, a document without words fails the
    base rules. Repeated ids and rows without id are judged row by row. Extra columns
    are not read. Without labels only the base rules reject; an empty table gives an
    empty result.
    """
    with scratch(docs.sparkSession, "quality_rules") as work:
        held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
        stats = work.table(statistics(docs, id_col, text_col), "statistics", keep=True)
        marks = (
            labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
            .where("doc_id is not null and label in (0, 1)")
            .groupBy("doc_id")
            .agg(F.min("label").alias("label"), F.max("label").alias("__other"))
            .where("label = __other")
        )
        known = work.table(
            stats.where(~held).join(marks, "doc_id").select(*STATISTICS, "doc_id", (1 - F.col("label")).alias("bad")),
            "labelled",
        )
        part = F.lit(min(how.rows / max(known.count(), 1), 1.0) * (1 << 30))
        drawn = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30))
        fold = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(3))
        sample = work.table(known.where(drawn < part).select(*STATISTICS, "bad", fold.alias("fold")), "sample")
        rules = learn(sample, how)
        failed = (F.col("n_words") < how.shortest) | (
            100 * F.col("n_repeat_words") > how.repeated * F.col("n_words")
        )
        texts = F.array(F.lit(""), *[F.lit(" and ".join(map(str, rule))) for rule in rules])
        return (
            stats.withColumn("rule", rule_number(rules))
            .withColumn("base_failed", failed)
            .select(
                "doc_id",
                "n_words",
                "word_chars",
                "n_symbols",
                "n_dup_lines",
                "n_repeat_words",
                "base_failed",
                (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"),
                "rule",
                texts[F.col("rule")].alias("rule_text"),
                F.coalesce(held, F.lit(False)).alias("held_out"),
            )
        )

