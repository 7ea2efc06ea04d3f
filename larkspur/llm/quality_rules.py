"""Quality rules: a decision list learned from labelled statistics.

`measure` takes statistics of whole texts with DataFrame functions. `learn_rules`
runs sequential covering over the statistics of labelled rows: grow a conjunction
of thresholds by information gain on one part of the rows, prune it on the other,
keep it if it is precise on rows that it was not grown on, take out what it covers,
and go on. The list becomes one ordered conditional expression (`verdict`); a text
that no rule rejects is kept.

The fit takes at most about MAX_LABELLED labelled rows (all if there are fewer),
chosen by a hash of the id. Counts cover whole texts of every row.

Null texts have no words; very long texts are measured whole, in one row. Without labels of both kinds no rule is learned and all
texts are kept. Repeated rows each keep their row; an empty table gives none. An input column with an
output's name is replaced. Of conditions with equal gain the first counts (by the order of FEATURES, then at most before at
least, then the lower threshold); labelled rows are put in order by id and statistics first, so the list doesn't depend on partitions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common

MAX_LABELLED = 20_000
SYMBOLS = "#*$%&|<>"
#: A word from its first symbol on.
SYMBOL_REST = r"[#*$%&|<>][^\x20\x09-\x0D]*+"
FEATURES = ("log_words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "dup_line_share", "repeat_share", "distinct_share", "line_words", "symbol_word_share")


def repeated_places(stats: DataFrame) -> DataFrame:
    """stats(hashes, span, ..) with `places`, in order, of the hashes that occur twice or more, in place of both.

    Plain numbers are sorted: the upper bits of a hash with its place below them (`span`: a power of two above all places). Neighbours with
    equal upper bits are the candidates; only in a text where such hashes differ are the candidates sorted again, by whole hashes.
    """
    h, top = F.col("hashes"), -F.col("span")
    stats = stats.withColumn("sorted", F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(top).bitwiseOR(i.cast("long")))))
    stats = common.settled(stats)
    s, c, t = F.col("sorted"), F.col("twice"), F.col("pairs")
    near = lambda a, x, k: F.coalesce(x.bitwiseXOR(F.get(a, k)).bitwiseAND(top) == 0, F.lit(False))
    stats = stats.withColumn("twice", F.filter(s, lambda x, k: near(s, x, k + 1) | near(s, x, k - 1))).drop("sorted")
    stats = common.settled(stats)
    place = lambda x: x.bitwiseAND(F.col("span") - 1).cast("int")
    mixed = F.size(F.filter(c, lambda x, k: near(c, x, k - 1) & (F.get(h, place(x)) != F.get(h, place(F.get(c, k - 1)))))) > 0
    whole = F.sort_array(F.transform(c, lambda x: F.struct(F.get(h, place(x)).alias("h"), place(x).alias("p"))))
    stats = stats.withColumn("pairs", F.when(mixed, whole)).withColumn("places", F.transform(c, place)).drop("twice", "hashes", "span")
    stats = common.settled(stats)
    same = lambda x, k: F.coalesce(F.get(t, k)["h"] == x["h"], F.lit(False))
    exact = F.transform(F.filter(t, lambda x, k: same(x, k + 1) | same(x, k - 1)), lambda x: x["p"])
    return common.settled(stats.withColumn("places", F.sort_array(F.coalesce(exact, F.col("places")))).drop("pairs"))


def measure(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns `keep` (all by default) with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and the shares in FEATURES."""
    outputs = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES}
    kept = [c for c in (keep if keep is not None else df.columns) if c not in outputs]
    body = df.select(F.struct(*kept).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    w = F.col("words")
    stats = body.select(
        "row",
        F.array_remove(F.split("body", common.SPACE_CLASS), "").alias("words"),
        F.filter(F.split("body", "\n"), lambda x: F.length(F.translate(x, common.SPACES, "")) > 0).alias("lines"),
        F.length(F.translate("body", common.SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.translate("body", SYMBOLS, "")).alias("no_symbols"),
        F.length(F.regexp_replace("body", r"\p{Lu}+", "")).alias("no_upper"),
        F.length(F.translate("body", "0123456789", "")).alias("no_digits"),
        F.length(F.translate("body", "!?", "")).alias("no_marks"),
        F.length("body").alias("chars"),
        F.regexp_count("body", F.lit(SYMBOL_REST)).alias("symbol_words"),
    )
    stats = common.settled(stats)
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    stats = stats.select(
        "*",
        F.size(w).cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct(w)).alias("n_distinct"),
        F.when(F.size(w) >= 3, windows).alias("hashes"),
        F.pow(F.lit(2), F.length(F.bin(F.size(w).cast("long")))).cast("long").alias("span"),
    ).drop("words", "lines")
    stats = repeated_places(common.settled(stats))
    p = F.col("places")
    covered = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    stats = stats.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    n_symbols = (F.col("chars") - F.col("no_symbols")).cast("long")
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    lost = lambda c: (F.col("chars") - F.col(c)) / chars
    stats = stats.select(
        "row", "n_words", "word_chars", n_symbols.alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        F.log1p(F.col("n_words").cast("double")).alias("log_words"),
        (F.col("word_chars") / words).alias("word_length"),
        lost("no_symbols").alias("symbol_share"),
        lost("no_upper").alias("upper_share"),
        lost("no_digits").alias("digit_share"),
        lost("no_marks").alias("mark_share"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_distinct") / words).alias("distinct_share"),
        (F.col("n_words") / F.greatest("n_lines", F.lit(1))).alias("line_words"),
        (F.col("symbol_words") / words).alias("symbol_word_share"),
    )
    stats = common.settled(stats)
    return stats.select("row.*", *(c for c in stats.columns if c != "row"))


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions (feature, is_at_least, threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int

    def column(self) -> Column:
        parts = [F.col(f) >= t if at_least else F.col(f) <= t for f, at_least, t in self.conditions]
        return reduce(lambda a, b: a & b, parts)

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>=' if a else '<='} {t:.6g}" for f, a, t in self.conditions)


def meets(x: np.ndarray, conditions: list[tuple[int, bool, float]]) -> np.ndarray:
    on = np.ones(len(x), bool)
    for f, at_least, t in conditions:
        on &= x[:, f] >= t if at_least else x[:, f] <= t
    return on


def best_condition(x: np.ndarray, bad: np.ndarray) -> tuple[float, tuple[int, bool, float] | None]:
    """The threshold with the highest information gain among rows x."""
    n, p = len(bad), bad.sum()
    base, best, found = np.log2(p / n), 0.0, None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, b = x[order, f], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1])  # between cut and cut + 1
        if not len(cut):
            continue
        low = np.cumsum(b)[cut]
        middle = (v[cut] + v[cut + 1]) / 2
        for at_least, pos, size in ((False, low, cut + 1), (True, p - low, n - cut - 1)):
            gain = pos * (np.log2(np.maximum(pos, 1e-9) / size) - base)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-9:
                best, found = float(gain[k]), (f, at_least, float(middle[k]))
    return best, found


def learn_rules(
    x: np.ndarray, bad: np.ndarray, names: tuple[str, ...] = FEATURES, max_rules: int = 16, max_conditions: int = 4, least_precision: float = 0.9, least_cover: int = 5, seed: int = 7
) -> list[Rule]:
    """An ordered list of rejecting rules; x holds a row of statistics per text, bad is true where it is labelled bad."""
    part = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    gx, gb, px, pb = x[part], bad[part].astype(float), x[~part], bad[~part].astype(float)
    rules: list[Rule] = []
    while len(rules) < max_rules and gb.sum() >= least_cover:
        conditions: list[tuple[int, bool, float]] = []
        on = np.ones(len(gb), bool)
        while len(conditions) < max_conditions and gb[on].mean() < 1:
            _, found = best_condition(gx[on], gb[on])
            if found is None:
                break
            conditions.append(found)
            on = meets(gx, conditions)

        def worth(c: list) -> float:
            hit = meets(px, c)
            good = pb[hit].sum()
            return (2 * good - hit.sum()) / max(1, hit.sum()) if c else -1.0

        options = [conditions[:k] for k in range(1, len(conditions) + 1)]
        if not options:
            break
        conditions = max(options, key=lambda c: (round(worth(c), 3), -len(c)))
        hit, on = meets(px, conditions), meets(gx, conditions)
        n, good = hit.sum() + on.sum(), pb[hit].sum() + gb[on].sum()
        held_out = (pb[hit].sum() + 1) / (hit.sum() + 2) if hit.sum() >= 10 else (good + 1) / (n + 2)
        if held_out < least_precision - 0.05 * (hit.sum() < 30) or good / max(n, 1) < least_precision or n < least_cover:
            break
        tight = {(f, a): max(t for g, b, t in conditions if (g, b) == (f, a)) if a else min(t for g, b, t in conditions if (g, b) == (f, a)) for f, a, _ in conditions}
        rules.append(Rule(tuple((names[f], a, t) for (f, a), t in tight.items()), float(good / n), int(n)))
        gx, gb, px, pb = gx[~on], gb[~on], px[~hit], pb[~hit]
    return rules


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from the labelled documents (label 0: bad), from a hashed sample of about max_labelled."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    n = known.count()
    if not n:
        return []
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    # about max_labelled rows of two numbers: bounded by the parameter
    sample = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    rows = measure(sample, keep=["doc_id", "label"]).select("doc_id", "label", *FEATURES).toPandas().sort_values(["doc_id", "label", *FEATURES])
    bad = rows["label"].to_numpy() == 0
    if not bad.any() or bad.all():
        return []
    return learn_rules(rows[list(FEATURES)].to_numpy(float), bad)


def verdict(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that rejects, else 0."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), F.lit(k)).otherwise(out)
    return out


def judge(documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """The statistics of each document with base_failed, rule (0: none) and kept."""
    rules = fit(documents, labels, doc_id, text) if rules is None else rules
    stats = measure(documents, text, keep)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
