"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.llm.labelled import fold, sample_labels, sigmoid
from pelagia.llm.shared import let, materialize, word_count

SAMPLE = 8000  # labelled rows of either label that trees and weights are fitted on
TREES, DEPTH, BINS = 40, 3, 48
LASSO = 0.002


def occurrences(text: Column, characters: str) -> Column:
    """How often the characters (ASCII) stand in a text."""
    out = F.lit(0)
    for c in characters:
        out = out + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return out


STATISTICS = [
    "characters", "words", "word_length", "capitals", "digits", "exclamations", "bars", "marks", "stops", "breaks", "brackets",
    "distinct_words", "repeated_words", "distinct_lines",
]


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, STATISTICS) that rules may ask about; null reads as empty, shares of nothing are 0.

    Two projections: the first measures each text once, the second only divides, so nothing is counted twice.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    gone = lambda pattern: F.octet_length(t) - F.octet_length(F.regexp_replace(t, pattern, ""))
    words = F.split(t, " ")
    measured = docs.select(
        F.col(id_col).alias("id"), F.char_length(t).alias("size"), word_count(F.col(text_col)).alias("count"), gone("[A-Z]").alias("capital"),
        gone("[0-9]+").alias("digit"), occurrences(t, "!").alias("exclamation"), occurrences(t, "|").alias("bar"), occurrences(t, "*#$%&").alias("mark"),
        occurrences(t, ".").alias("stop"), occurrences(t, "\n").alias("break"), occurrences(t, "<>{}[]").alias("bracket"),
        # The words are bound once; inside the inner lambda a split would be redone for every word.
        let(words, lambda ws: F.struct(
            F.size(ws).alias("all"), F.size(F.array_distinct(ws)).alias("distinct"), F.size(F.filter(ws, lambda w, i: w == F.get(ws, i + 1))).alias("again"),
        )).alias("w"),
        let(F.split(t, "\n"), lambda ls: F.size(F.array_distinct(ls)) / F.size(ls)).alias("lines"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return measured.select(
        "id", F.log1p("size").alias("characters"), F.log1p("count").alias("words"), share("size", "count").alias("word_length"),
        share("capital", "size").alias("capitals"), share("digit", "size").alias("digits"), share("exclamation", "count").alias("exclamations"),
        share("bar", "count").alias("bars"), share("mark", "count").alias("marks"), share("stop", "count").alias("stops"),
        share("break", "count").alias("breaks"), share("bracket", "count").alias("brackets"), share("w.distinct", "w.all").alias("distinct_words"),
        share("w.again", "w.all").alias("repeated_words"), F.col("lines").alias("distinct_lines"),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: every (statistic, low, high) must hold as low < value <= high."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low > -np.inf:
                out = out & (F.col(name) > float(low))
            if high < np.inf:
                out = out & (F.col(name) <= float(high))
        return out

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, low, high in self.bounds:
            v = x[:, names.index(name)]
            out &= (v > low) & (v <= high)
        return out


def best_split(codes: np.ndarray, gradient: np.ndarray, curve: np.ndarray, least: int) -> tuple[float, int, int]:
    """(gain, statistic, last code of the left side) of the split that lowers the second-order loss most."""
    best = (1e-3, -1, 0)
    value = lambda g, h: g * g / (h + 1.0)
    for f in range(codes.shape[1]):
        g = np.cumsum(np.bincount(codes[:, f], gradient, BINS))
        h = np.cumsum(np.bincount(codes[:, f], curve, BINS))
        n = np.cumsum(np.bincount(codes[:, f], minlength=BINS))
        gain = value(g, h) + value(g[-1] - g, h[-1] - h) - value(g[-1], h[-1])
        gain[(n < least) | (n[-1] - n < least)] = -1
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (float(gain[at]), f, at)
    return best


def grow(codes, rows, gradient, curve, depth, path, least) -> Iterator[tuple[np.ndarray, tuple, bool]]:
    """Nodes of a tree as (rows, path of (statistic, code, left side), is leaf)."""
    split = best_split(codes[rows], gradient[rows], curve[rows], least) if depth else (0, -1, 0)
    if path:
        yield rows, path, split[1] < 0
    elif split[1] < 0:
        return
    if split[1] >= 0:
        left = codes[rows, split[1]] <= split[2]
        yield from grow(codes, rows[left], gradient, curve, depth - 1, (*path, (split[1], split[2], True)), least)
        yield from grow(codes, rows[~left], gradient, curve, depth - 1, (*path, (split[1], split[2], False)), least)


def tree_rules(x: np.ndarray, y: np.ndarray, times: np.ndarray, names: list[str], seed: int = 5) -> list[Rule]:
    """Every path of boosted trees as a rule, each once, in the order found. A row counts ``times``."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    rng, score, rules = np.random.default_rng(seed), np.zeros(len(x)), {}
    least = max(5, len(x) // 400)
    times = times / times.mean()  # how sure a split is depends on the rows there are
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        gradient, curve = times * (p - y), times * p * (1 - p)
        rows = np.flatnonzero(rng.random(len(x)) < 0.7)
        for held, path, leaf in grow(codes, rows, gradient, curve, DEPTH, (), least):
            bounds: dict[str, tuple[float, float]] = {}
            for f, code, is_left in path:
                low, high = bounds.get(names[f], (-np.inf, np.inf))
                cut = float(edges[f][code]) if code < len(edges[f]) else np.inf
                bounds[names[f]] = (low, min(high, cut)) if is_left else (max(low, cut), high)
            rule = Rule(tuple(sorted((k, *v) for k, v in bounds.items())))
            rules.setdefault(rule)
            if leaf:
                score += 0.3 * np.clip(-gradient[held].sum() / (curve[held].sum() + 1.0), -3, 3) * rule.holds(x, names)
    return list(rules)


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600, times: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; most weights end at exactly 0."""
    share = np.full(len(y), 1 / len(y)) if times is None else times / times.sum()
    bound = 0.25 * np.linalg.norm(np.column_stack([np.ones(len(y)), m]) * np.sqrt(share)[:, None], 2) ** 2
    w, look, t = np.zeros(m.shape[1] + 1), np.zeros(m.shape[1] + 1), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(look[0] + m @ look[1:], -30, 30)))
        step = look - np.concatenate([[share @ (p - y)], m.T @ (share * (p - y))]) / bound
        new = np.concatenate([step[:1], np.sign(step[1:]) * np.maximum(np.abs(step[1:]) - penalty / bound, 0)])
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, times: np.ndarray, names: list[str]) -> tuple[float, list[tuple[float, Rule]]]:
    """(intercept, [(weight, rule)]) with the rules that the lasso keeps; a row counts ``times``."""
    ones, every = float(times @ y), float(times.sum())
    if not len(y) or y.min() == y.max():
        return (float(np.log((ones + 0.5) / (every - ones + 0.5))) if len(y) else 0.0), []
    rules = tree_rules(x, y, times, names)
    if not rules:
        return float(np.log(ones / (every - ones))), []
    held = np.column_stack([r.holds(x, names) for r in rules]).astype(np.float64)
    intercept, weights = lasso_logistic(held, y.astype(np.float64), LASSO, times=times)
    return intercept, [(float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-6]


def quality_scores(
    docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, held_out: int = 0, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, held_out, score, predicted and the statistics): how likely every whole text is of quality 1.

    Boosted trees are fitted to the statistics of at most ``sample`` rows of either label outside the held-out fold,
    weighted to the labels' shares there; their paths become rules, a lasso keeps few of them, and the sum of the rules that hold is scored in one Spark
    projection. Ids, languages, sources and labels never enter a score.

    Null and empty texts have statistics of nothing and are scored like any other; null ids keep their rows
    (held_out false). Without labels, or with one kind only, every score is the share of label 1 (one half without
    any). Rows that repeat an id are scored each; one of them, by the least hash of its statistics, is learned from. An
    empty table gives no rows.
    """
    names = STATISTICS
    rows = materialize(with_statistics(docs, id_col, text_col), "statistics")
    train = sample_labels(labels, label, fold(id_col, parts) != held_out, sample, id_col)
    # At most 2 * sample ids, so the labels are small enough to send to every task.
    # One row stands for an id, so that rows that repeat it neither crowd out others nor count more.
    one = F.min(F.struct(F.xxhash64(*names).alias("h"), *names)).alias("one")
    chosen = rows.join(F.broadcast(train), "id").groupBy("id", "y", "weight").agg(one).select("y", "weight", "one.*")
    fitted = chosen.drop("h").orderBy("y", *names).toPandas()  # at most 2 * sample rows
    intercept, rules = fit_rules(*(fitted[c].to_numpy(float) for c in (names, "y", "weight")), names)
    z = F.lit(intercept)
    for weight, rule in rules:
        z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
    return rows.withColumn("score", sigmoid(z)).select(
        "id", F.coalesce(fold("id", parts) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), *names
    )
