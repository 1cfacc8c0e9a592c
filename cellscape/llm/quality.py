"""Quality rules: an ordered decision list learned by sequential covering.

Figures of a text become shares and means.  From labelled rows, rules for the class "reject" are grown
one condition at a time by information gain on two thirds of the rows and pruned on the other third; rows that
a rule covers leave, and learning ends when a rule's precision on the pruning rows is too low.  The list is
emitted as one ordered Spark conditional.  Everything is DataFrame expressions; the driver sees only counts
per feature and threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cellscape.llm.common import WORD, text_of, unused, words_of
from cellscape.llm.labelled import labelled_sample
from cellscape.session import cut_lineage

WINDOW = 5
#: Fixed pattern: characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Most labelled rows that the list is learned from.
SAMPLE_ROWS = 20_000
THRESHOLDS = 40
MAX_RULES, MAX_CONDITIONS = 8, 3
MIN_COVER, MIN_PRECISION = 5, 0.75

FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_distinct"]
FEATURES = ["symbol_share", "repeat_share", "dup_line_share", "upper_share", "mark_share", "digit_share", "distinct_share", "mean_word", "n_words"]


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _held(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: transform over an array of one element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeat_words(grams: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; ``grams`` are the 64-bit hashes of the windows by start."""

    def starts(s: Column) -> Column:
        twin = lambda x, k: F.get(s, k)["h"].eqNullSafe(x["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, k: twin(x, k - 1) | twin(x, k + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, n: a + n)

    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = _held(ordered, lambda s: _held(starts(s), covered))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(found)


def _windows(h: Column) -> Column:
    """64-bit hashes of the word windows from the hashes of the words."""
    last = F.size(h) - WINDOW
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    return F.when(last >= 0, F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))


def figures_of(text: Column) -> Column:
    """Struct with the figures of a text, null as the empty text.

    Words, their hashes, windows and lines exist inside the expression only, one text at a time; rows hold the text and
    ten numbers.
    """

    def of_words(h: Column) -> Column:
        return F.struct(F.size(h).cast("long").alias("n_words"), _held(_windows(h), repeat_words).alias("n_repeat_words"), F.size(F.array_distinct(h)).cast("long").alias("n_distinct"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    def of_text(t: Column) -> Column:
        words = _held(F.transform(words_of(t), lambda w: F.xxhash64(w)), of_words)
        lines = _held(F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)), of_lines)
        counts = F.struct(
            F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            _count(t, SYMBOLS).alias("n_symbols"), _count(t, r"\p{Lu}").alias("n_upper"), _count(t, r"[!?]").alias("n_marks"), _count(t, r"[0-9]").alias("n_digits"),
        )
        every = F.struct(words.alias("w"), lines.alias("l"), counts.alias("c"))
        of = {"n_words": "w", "n_repeat_words": "w", "n_distinct": "w", "n_lines": "l", "n_dup_lines": "l"}
        return _held(every, lambda x: F.struct(*[x[of.get(n, "c")][n].alias(n) for n in FIGURES]))

    return _held(text, of_text)


def with_figures(docs: DataFrame, text: str = "text", into: str = "figures") -> DataFrame:
    """Add struct ``into`` with the figures of each text; null texts count as empty."""
    # the explode keeps later filters above this step, so figures are computed once
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array(figures_of(text_of(text)))).alias(into))


def features_of(f: Column) -> dict[str, Column]:
    per = lambda a, b: f[a] / F.greatest(f[b], F.lit(1))
    return {
        "symbol_share": per("n_symbols", "word_chars"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "upper_share": per("n_upper", "word_chars"),
        "mark_share": per("n_marks", "word_chars"),
        "digit_share": per("n_digits", "word_chars"),
        "distinct_share": per("n_distinct", "n_words"),
        "mean_word": per("word_chars", "n_words"),
        "n_words": f["n_words"].cast("double"),
    }


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])


@dataclass(frozen=True)
class Condition:
    """``feature >= limit`` or ``feature < limit``; ``bin`` is the limit's place among the thresholds."""

    feature: str
    at_least: bool
    limit: float
    bin: int

    def on_bins(self) -> Column:
        b = F.col(f"b_{self.feature}")
        return b >= self.bin if self.at_least else b < self.bin

    def on(self, features: dict[str, Column]) -> Column:
        return features[self.feature] >= self.limit if self.at_least else features[self.feature] < self.limit


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    rejected: int
    wrong: int

    def on(self, features: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.on(features)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>=' if c.at_least else '<'} {c.limit:.6g}" for c in self.conditions)


def thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Distinct quantiles per feature, denser at the ends; one grouped pass."""
    inner = [i / THRESHOLDS for i in range(1, THRESHOLDS)]
    asked = sorted({*inner, 0.002, 0.005, 0.01, 0.015, 0.985, 0.99, 0.995, 0.998})
    got = rows.agg(*[F.percentile_approx(f, asked, 10_000).alias(f) for f in FEATURES]).first()
    return {f: sorted({x for x in (got[f] or []) if x is not None}) for f in FEATURES}


def binned(rows: DataFrame, limits: dict[str, list[float]]) -> DataFrame:
    """Rows of (good, bad, part, b_<feature>): the number of thresholds at or below each value, equal rows counted once."""
    bins = rows.select(*[_place(f, limits[f]).alias(f"b_{f}") for f in FEATURES], "__label", "__part")
    return bins.groupBy(*[f"b_{f}" for f in FEATURES], "__part").agg(F.sum("__label").alias("good"), F.sum(1 - F.col("__label")).alias("bad"))


def _place(feature: str, limits: list[float]) -> Column:
    if not limits:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in limits]), lambda t: t <= F.col(feature)))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9)))


def _best_condition(rows: DataFrame, limits: dict[str, list[float]]) -> Condition | None:
    """The condition of highest gain for rejected rows; counts per (feature, bin) come from one grouped pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in FEATURES]))
    counts = rows.select("good", "bad", pairs.alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum("good").alias("n")).collect()
    best, found = 1e-6, None
    for f in FEATURES:
        own = {r.b: (r.p, r.n) for r in counts if r.f == f}
        p0, n0 = sum(p for p, _ in own.values()), sum(n for _, n in own.values())
        p, n = 0, 0
        for k, limit in enumerate(limits[f], 1):
            p, n = p + own.get(k - 1, (0, 0))[0], n + own.get(k - 1, (0, 0))[1]
            for at_least, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                if a >= MIN_COVER and a + b < p0 + n0 and (g := _gain(a, b, p0, n0)) > best:
                    best, found = g, Condition(f, at_least, limit, k)
    return found


def learn_rules(rows: DataFrame) -> list[Rule]:
    """Decision list for "reject" from rows with the features, ``__label`` (1 good) and ``__part`` (2: pruning rows)."""
    limits = thresholds(rows)
    left = cut_lineage(binned(rows, limits).coalesce(4))
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        conditions: list[Condition] = []
        grow = left.where("__part < 2")
        while len(conditions) < MAX_CONDITIONS and (c := _best_condition(grow, limits)):
            conditions.append(c)
            grow = grow.where(c.on_bins())
        if not conditions:
            break
        # prune: the prefix of conditions with the best (p - n) / (p + n) on the pruning rows
        holds, sums = F.col("__part") == 2, []
        for k, c in enumerate(conditions):
            holds = holds & c.on_bins()
            sums += [F.sum(F.when(holds, F.col("bad")).otherwise(0)).alias(f"p{k}"), F.sum(F.when(holds, F.col("good")).otherwise(0)).alias(f"n{k}")]
        seen = left.agg(*sums).first()
        worth = lambda k: ((seen[f"p{k}"] or 0) - (seen[f"n{k}"] or 0)) / ((seen[f"p{k}"] or 0) + (seen[f"n{k}"] or 0) + 1)  # noqa: E731, B023
        k = max(range(len(conditions)), key=lambda k: (worth(k), -k))
        p, n = seen[f"p{k}"] or 0, seen[f"n{k}"] or 0
        if p < MIN_COVER or p < MIN_PRECISION * (p + n):
            break
        rule = Rule(tuple(conditions[: k + 1]), int(p), int(n))
        rules.append(rule)
        covered = F.lit(True)
        for c in rule.conditions:
            covered = covered & c.on_bins()
        left = left.where(~covered)
    return rules


def decision(rules: list[Rule], features: dict[str, Column]) -> tuple[Column, Column]:
    """(kept, number of the rule that fired or null) as ordered conditionals; no rule: kept."""
    if not rules:
        return F.lit(True), F.lit(None).cast("int")
    kept, fired = F.when(rules[0].on(features), False), F.when(rules[0].on(features), 0)
    for i, rule in enumerate(rules[1:], 1):
        kept, fired = kept.when(rule.on(features), False), fired.when(rule.on(features), i)
    return kept.otherwise(True), fired.cast("int")


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from at most ``bound`` labelled rows; rows that fail the base take no part; no rules without labels."""
    sample = labelled_sample(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels, "quality", bound)
    f = F.col("figures")
    rows = with_figures(sample).where(~base_failed(f)).select("__label", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)).alias("__part"), *[c.alias(n) for n, c in features_of(f).items()])
    return learn_rules(cut_lineage(rows))


def judge_quality(docs: DataFrame, rules: list[Rule], text: str = "text", into: str = "judged") -> DataFrame:
    """``docs`` with struct ``into``: the figures of ``FIGURES``, base_failed, kept and rule.

    Null and empty texts have no words and fail the base.  Rows are independent: repeated rows are judged alike.
    Without labels there are no rules and only the base decides.  ``into`` must not be a column of ``docs``.
    """
    f = F.col(f"`{into}`")
    failed = base_failed(f)
    kept, fired = decision(rules, features_of(f))
    judged = F.struct(*[f[n].alias(n) for n in FIGURES], failed.alias("base_failed"), (~failed & kept).alias("kept"), F.when(~failed, fired).alias("rule"))
    return with_figures(docs, text, into).withColumn(into, judged)


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, figures, base_failed, kept, rule; odd inputs as in ``judge_quality``."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    judged = judge_quality(slim, fit_quality(slim, labels))
    return judged.select("doc_id", *[F.col(f"judged.{c}") for c in FIGURES[:5]], "judged.base_failed", "judged.kept", "judged.rule")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass the base and the list, with their columns, whatever their names.

    Null, empty and short texts fail the base and go; repeated rows stay or go together; an empty table stays empty.
    """
    into = unused("judged", docs)
    judged = judge_quality(docs, fit_quality(docs, labels), into=into)
    return judged.where(F.col(f"`{into}`.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
