"""Quality rules: statistics of whole texts, and decision lists learned from labels.

All of it is built-in Spark SQL. Statistics are array expressions inside one scan; learning
asks Spark for counts per feature and bin and only ever sees those counts; the learned list is
an ordered ``CASE WHEN`` that is evaluated next to the statistics.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.session import staging_path

_SPACE = r"[\x20\x09-\x0D]"
_POSITION_BITS = 20
_POSITIONS = (1 << _POSITION_BITS) - 1

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test: shares, so that a threshold means the same for texts of any length.
FEATURES = {
    "n_words": F.col,
    "mean_word": lambda _: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "symbol_share": lambda _: F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
    "dup_lines_per_word": lambda _: F.col("n_dup_lines") / F.greatest("n_words", F.lit(1)),
    "repeat_share": lambda _: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
}
#: Cut points lie between these quantiles of the labelled rows, finer towards both ends.
QUANTILES = (0.005, 0.01, 0.02, 0.05, *(i / 20 for i in range(2, 19)), 0.95, 0.98, 0.99, 0.995)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five statistics of the whole text.

    ``n_words`` and ``word_chars`` count words and their characters, ``n_symbols`` the
    characters ``#*$%&|<>``, ``n_dup_lines`` lines with a word that equal an earlier line,
    ``n_repeat_words`` words inside a window of three words that occurs twice or more.

    A null text counts as an empty one: all are 0. Windows are compared by a 64-bit hash.
    Working columns start with ``_q_`` and are dropped again; a column of ``docs`` with the
    name of a statistic is replaced.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    words = F.split(F.expr(r"trim(BOTH ' \t\n\u000B\f\r' FROM _q_text)"), f"{_SPACE}+", -1)
    lines = F.filter(F.split("_q_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.withColumn("_q_text", content).withColumns(
        {
            "_q_words": F.filter(words, lambda w: w != ""),
            "_q_lines": lines,
            "n_symbols": F.regexp_count("_q_text", F.lit(r"[#*$%&|<>]")).cast("bigint"),
            "word_chars": (
                F.char_length("_q_text") - F.regexp_count("_q_text", F.lit(_SPACE))
            ).cast("bigint"),
        }
    )
    # A window is known by the hash of its words; the last two positions start none.
    grams = F.transform(
        "_q_words",
        lambda w, i: F.xxhash64(w, F.get("_q_words", i + 1), F.get("_q_words", i + 2)),
    )
    step = step.withColumns(
        {
            "n_words": F.size("_q_words").cast("bigint"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("bigint"),
            "_q_grams": F.when(
                F.size("_q_words") >= 3, F.slice(grams, F.lit(1), F.size("_q_words") - 2)
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    step = _with_repeats(step)
    # Each row generates one row of statistics. Filters on them stop here; pushed further
    # down they would repeat the expressions they are made of, over and over.
    own = [F.col(f"`{c}`") for c in docs.columns if c not in STATISTICS]
    return step.select(*own, F.inline(F.array(F.struct(*STATISTICS))))


def _with_repeats(step: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``, the words covered by windows that occur more than once.

    Hash and position are packed into one number, sorted, and neighbours compared: equal
    windows end up side by side. The position takes the low bits; the rare neighbours that
    agree in the high bits alone are told apart by the whole hash. A text of more positions
    than those bits hold is sorted as pairs.
    """
    packed = F.sort_array(
        F.transform("_q_grams", lambda g, i: g.bitwiseAND(F.lit(~_POSITIONS)).bitwiseOR(i.cast("bigint")))
    )
    pairs = F.sort_array(
        F.transform("_q_grams", lambda g, i: F.struct(g.alias("g"), i.cast("bigint").alias("i")))
    )
    long_text = F.size("_q_grams") > _POSITIONS
    step = step.withColumns(
        {
            "_q_packed": F.when(long_text, F.array().cast("array<bigint>")).otherwise(packed),
            "_q_pairs": F.when(long_text, pairs),
        }
    )

    def gram(x: Column) -> Column:
        return F.get("_q_grams", x.bitwiseAND(F.lit(_POSITIONS)).cast("int"))

    def twin(x: Column, i: Column) -> Column:
        before, after = F.get("_q_packed", i - 1), F.get("_q_packed", i + 1)
        near = (F.shiftright(x, _POSITION_BITS) == F.shiftright(before, _POSITION_BITS)) & (
            gram(x) == gram(before)
        )
        far = (F.shiftright(x, _POSITION_BITS) == F.shiftright(after, _POSITION_BITS)) & (
            gram(x) == gram(after)
        )
        return F.coalesce(near, F.lit(False)) | F.coalesce(far, F.lit(False))

    def pair_twin(x: Column, i: Column) -> Column:
        before, after = F.get("_q_pairs", i - 1)["g"], F.get("_q_pairs", i + 1)["g"]
        return F.coalesce(x["g"] == before, F.lit(False)) | F.coalesce(x["g"] == after, F.lit(False))

    short = F.transform(F.filter("_q_packed", twin), lambda x: x.bitwiseAND(F.lit(_POSITIONS)))
    long = F.transform(F.filter("_q_pairs", pair_twin), lambda x: x["i"])
    step = step.withColumn("_q_at", F.sort_array(F.coalesce(long, short)))
    # A window covers three words, fewer if the next one begins before its end.
    covered = F.transform(
        "_q_at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_q_at", i + 1) - x, F.lit(3)))
    )
    total = F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return step.withColumn("n_repeat_words", total)


def base_failed() -> Column:
    """True for texts that fail whatever was learned: too short, or mostly repetition."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = FEATURES[self.feature](self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects, with its precision and support on rows it was not grown on."""

    conditions: tuple[Condition, ...]
    precision: float
    support: int

    def column(self) -> Column:
        matched = F.lit(True)
        for condition in self.conditions:
            matched = matched & condition.column()
        return matched

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Rules in the order in which they are tried; a row that meets none is kept."""

    rules: tuple[Rule, ...]

    def kept(self) -> Column:
        verdict = F.when(base_failed(), F.lit(False))
        for rule in self.rules:
            verdict = verdict.when(rule.column(), F.lit(False))
        return verdict.otherwise(F.lit(True))

    def reason(self) -> Column:
        """The rule that rejects a row, as text; null for a kept row."""
        verdict = F.when(base_failed(), F.lit("base"))
        for rule in self.rules:
            verdict = verdict.when(rule.column(), F.lit(str(rule)))
        return verdict


def labelled_sample(labels: DataFrame, row_id: str, label: str, fit_rows: int) -> DataFrame:
    """At most ``fit_rows`` labelled ids in a random but repeatable order, and ``_bad``.

    An id with several labels counts as bad if one of them says so; null ids and null labels
    are left out.
    """
    one_each = (
        labels.where(F.col(row_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(row_id)
        .agg((F.min(label) == 0).alias("_bad"))
    )
    return one_each.orderBy(F.xxhash64(row_id), row_id).limit(fit_rows)


def learn_rules(
    docs: DataFrame,
    labels: DataFrame,
    row_id: str = "doc_id",
    label: str = "quality",
    text: str = "text",
    fit_rows: int = 20_000,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_support: int = 5,
) -> DecisionList:
    """A decision list that rejects rows like those labelled 0.

    Sequential covering: a rule is grown condition by condition on two thirds of the labelled
    rows not yet covered, by information gain; cut back to its best prefix on the other third;
    and taken if it is precise there. It is learned from at most ``fit_rows`` labelled rows,
    whatever the size of the corpus, each with its whole text. Without labels, or
    with none that support a rule, the list is empty and only the base rules hold.
    """
    spark = docs.sparkSession
    path = staging_path(spark, "quality-sample")
    # The sample has a fixed bound, so it can be broadcast.
    sample = labelled_sample(labels, row_id, label, fit_rows)
    rows = with_statistics(docs.select(row_id, text).join(F.broadcast(sample), row_id), text)
    rows = rows.where(~base_failed()).select(
        "_bad",
        (F.pmod(F.xxhash64(row_id), F.lit(3)) == 0).alias("_prune"),
        *[make(name).cast("double").alias(name) for name, make in FEATURES.items()],
    )
    rows.write.parquet(path)
    rows = spark.read.parquet(path)

    cuts = _cut_points(rows)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows
        for rule in rules:
            left = left.where(~_matches(rule.conditions))
        grown = _grow(left.where("NOT _prune"), cuts, max_conditions, min_support)
        rule = _prune(left.where("_prune"), grown)
        if rule is None or rule.precision < min_precision or rule.support < min_support:
            break
        rules.append(rule)
    return DecisionList(tuple(rules))


def _matches(conditions: Sequence[Condition]) -> Column:
    """Conditions on the stored feature columns."""
    matched = F.lit(True)
    for c in conditions:
        matched = matched & (F.col(c.feature) > c.threshold if c.above else F.col(c.feature) <= c.threshold)
    return matched


def _cut_points(rows: DataFrame) -> dict[str, list[float]]:
    found = rows.agg(
        *[F.percentile_approx(n, list(QUANTILES), 10_000).alias(n) for n in FEATURES]
    ).first()
    # Half way between values that occur, so that a rule keeps its distance from both.
    values = {n: sorted(set(found[n] or [])) for n in FEATURES}
    return {n: [(a + b) / 2 for a, b in zip(v, v[1:])] for n, v in values.items()}


def _grow(
    rows: DataFrame, cuts: dict[str, list[float]], max_conditions: int, min_support: int
) -> list[Condition]:
    conditions: list[Condition] = []
    while len(conditions) < max_conditions:
        best = _best_condition(rows.where(_matches(conditions)), cuts, min_support)
        if best is None:
            break
        conditions.append(best)
    return conditions


def _best_condition(
    rows: DataFrame, cuts: dict[str, list[float]], min_support: int
) -> Condition | None:
    """The test with the highest information gain, from bin counts of one pass."""
    binned = F.array(*[_cell(name, cuts[name]) for name in FEATURES if cuts[name]])
    if not any(cuts.values()):
        return None
    counted = (
        rows.select("_bad", F.explode(binned).alias("_cell"))
        .groupBy("_cell.feature", "_cell.bin")
        .agg(F.count_if("_bad").alias("bad"), F.count_if(~F.col("_bad")).alias("good"))
        .collect()
    )
    best, best_gain = None, 1e-9
    for name in FEATURES:
        bins = {r["bin"]: (r["bad"], r["good"]) for r in counted if r["feature"] == name}
        bad, good = (sum(v[i] for v in bins.values()) for i in (0, 1))
        below = [0, 0]
        for i, cut in enumerate(cuts[name]):
            below = [below[k] + bins.get(i, (0, 0))[k] for k in (0, 1)]
            for above, (p, n) in ((False, below), (True, (bad - below[0], good - below[1]))):
                if p < min_support or n == good:
                    continue
                gain = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                if gain > best_gain:
                    best, best_gain = Condition(name, above, cut), gain
    return best


def _cell(feature: str, cuts: list[float]) -> Column:
    """A feature's name and the number of its cut points below a row's value."""
    below = F.filter(F.array(*map(F.lit, cuts)), lambda cut: F.col(feature) > cut)
    return F.struct(F.lit(feature).alias("feature"), F.size(below).alias("bin"))


def _prune(rows: DataFrame, conditions: list[Condition]) -> Rule | None:
    """The prefix of the rule that separates held-back rows best."""
    if not conditions:
        return None
    counts = []
    for length in range(1, len(conditions) + 1):
        matched = _matches(conditions[:length])
        counts.append(F.count_if(matched & F.col("_bad")).alias(f"bad_{length}"))
        counts.append(F.count_if(matched & ~F.col("_bad")).alias(f"good_{length}"))
    seen = rows.agg(*counts).first()

    def worth(length: int) -> float:
        bad, good = seen[f"bad_{length}"], seen[f"good_{length}"]
        return (bad - good) / max(1, bad + good)

    best = max(range(1, len(conditions) + 1), key=worth)
    bad, good = seen[f"bad_{best}"], seen[f"good_{best}"]
    return Rule(tuple(conditions[:best]), bad / max(1, bad + good), bad)


def score_quality(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``kept`` and ``reason``.

    Every row stays, in one scan without a shuffle. Null and empty texts fail the base rules.
    Ties and repeated rows get equal verdicts. An empty table stays empty.
    """
    scored = with_statistics(docs, text)
    return scored.withColumns(
        {"base_failed": base_failed(), "kept": rules.kept(), "reason": rules.reason()}
    )


def keep_good(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with just the columns of ``docs``."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("_q_row"), F.col(text).alias("_q_source"))
    return with_statistics(rows, "_q_source").where(rules.kept()).select("_q_row.*")
