"""Problem 2: consensus from several annotators' labels.

A mean-field variational confusion model.  Every item has a hidden class 0..5 and every annotator a matrix
of the probabilities to give each symbol (the half points 0, 0.5 .. 5) for each class.  Classes and matrix
rows have Dirichlet priors; an iteration is two group-bys: the items' class posteriors from the annotators'
expected log probabilities (digamma), then the annotators' expected counts from the posteriors.  What grows
with the labels stays distributed; the annotators' table (66 numbers an annotator) is joined, and broadcast
by Spark only while it is below the session's threshold.

The model gives each annotator a posterior of the accuracy, with an interval (beta quantiles); an item's consensus is
the whole number that its careful annotators gave most often.  Careful are those above the cut that parts the
expected accuracies into two groups (least variance within them, each annotator by the number of labels); where two
groups explain no more than a single one would, they are those that are right more often than not.  Where
none is careful, or numbers tie, the item's class posterior decides.

The iterations end when no expected accuracy changes by ``CHANGE``; whether that was reached within ``ROUNDS`` is
reported (``converged``), and logged if not.

Defined cases: of several labels of one annotator for one item the latest ``created_at`` counts (null before
any, then the largest id); if that one is null, off the scale or no half point, the annotator gave none.
Null items or annotators are left out.  Repeated rows count once.  Items below ``LEAST`` annotators have no
consensus but still inform the model.  Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import materialize, release

CLASSES = 6  #: 0 .. 5
SYMBOLS = 11  #: 0, 0.5 .. 5
LEAST = 3  #: annotators that a consensus needs
ONE_GROUP = 0.5  #: least expected accuracy of a careful annotator where there is one group only
SPLIT = 0.75  #: least share of the variance that two groups explain; for a single normal group it is 0.64
ROUNDS = 50  #: iterations at most
CHANGE = 0.002  #: iterations end when the annotators' expected accuracies change by less
CLASS_PRIOR = 1.0
RIGHT_PRIOR, NEAR_PRIOR, OTHER_PRIOR = 2.0, 0.3, 0.15  #: pseudo-counts: right symbol, half a point beside, any other


def latest_labels(annotations: DataFrame) -> DataFrame:
    """(item, annotator, symbol): the label that counts, as twice its value."""
    named = annotations.select(F.col("item_id").alias("item"), F.col("annotator_id").alias("annotator"), "label", "created_at", "id")
    last = named.filter("item is not null and annotator is not null").groupBy("item", "annotator")
    last = last.agg(F.max(F.struct("created_at", "id", "label"))["label"].alias("label"))
    twice = F.col("label") * 2
    return last.filter((F.col("label") >= 0) & (F.col("label") <= CLASSES - 1) & (twice == F.floor(twice))).select("item", "annotator", twice.cast("int").alias("symbol"))


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the logarithm of the gamma function, for x > 0."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def _prior() -> np.ndarray:
    distance = np.abs(np.arange(SYMBOLS)[None, :] - 2 * np.arange(CLASSES)[:, None])
    return np.where(distance == 0, RIGHT_PRIOR, np.where(distance == 1, NEAR_PRIOR, OTHER_PRIOR))


def _expected_logs(counts: DataFrame) -> DataFrame:
    """(annotator, symbol, e0..e5) from the expected counts (annotator, symbol, n0..n5)."""
    kind = dict(counts.dtypes)["annotator"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = _prior()
        a[:, pdf["symbol"].to_numpy()] += pdf[[f"n{k}" for k in range(CLASSES)]].to_numpy().T
        e = digamma(a) - digamma(a.sum(axis=1, keepdims=True))
        return pd.DataFrame({"annotator": [pdf["annotator"].iloc[0]] * SYMBOLS, "symbol": np.arange(SYMBOLS, dtype=np.int32)} | {f"e{k}": e[k] for k in range(CLASSES)})

    # an annotator's group has at most SYMBOLS rows
    return counts.groupBy("annotator").applyInPandas(one, f"annotator {kind}, symbol int, " + ", ".join(f"e{k} double" for k in range(CLASSES)))


def _softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs)
    shares = [F.exp(x - top) for x in logs]
    total = sum(shares[1:], shares[0])
    return [s / total for s in shares]


def beta_interval(mean: float, sd: float, mass: float = 0.95) -> tuple[float, float]:
    """The central interval of the beta distribution with this mean and standard deviation."""
    if not 0 < mean < 1 or sd <= 0:
        return mean, mean
    size = max(mean * (1 - mean) / sd**2 - 1, 1e-3)
    a, b = mean * size, (1 - mean) * size
    edges = np.linspace(max(0.0, mean - 9 * sd), min(1.0, mean + 9 * sd), 4001)
    x = (edges[1:] + edges[:-1]) / 2
    logs = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    below = np.concatenate([[0], np.cumsum(np.exp(logs - logs.max()))])
    return tuple(float(q) for q in np.interp([(1 - mass) / 2, (1 + mass) / 2], below / below[-1], edges))


def two_groups(values: np.ndarray, weights: np.ndarray) -> float | None:
    """The middle of the gap between the two groups of values with the least variance within them; None if they explain
    less than SPLIT of the variance."""
    order = np.argsort(values)
    x, w = values[order], weights[order]
    keep = w > 0
    x, w = x[keep], w[keep]
    if len(x) < 2:
        return None
    n, s = np.cumsum(w), np.cumsum(w * x)
    total = (w * (x - s[-1] / n[-1]) ** 2).sum()
    left, right = s[:-1] / n[:-1], (s[-1] - s[:-1]) / (n[-1] - n[:-1])
    between = n[:-1] * (n[-1] - n[:-1]) / n[-1] * (left - right) ** 2
    k = int(between.argmax())
    return float((x[k] + x[k + 1]) / 2) if total > 0 and between[k] >= SPLIT * total else None


def _accuracy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Posterior mean and 95 % interval of an annotator's probability to give the right whole number."""
    prior = _prior()
    n = np.zeros((CLASSES, SYMBOLS))
    n[:, pdf["symbol"].to_numpy()] = pdf[[f"n{k}" for k in range(CLASSES)]].to_numpy().T
    a = prior + n
    weight = n.sum(axis=1) / max(n.sum(), 1e-12)
    right = a[np.arange(CLASSES), 2 * np.arange(CLASSES)]
    total = a.sum(axis=1)
    mean = right / total
    var = mean * (1 - mean) / (total + 1)
    m, s = float((weight * mean).sum()), float(np.sqrt((weight**2 * var).sum()))
    low, high = beta_interval(m, s)
    offset = (n * (np.arange(SYMBOLS)[None, :] / 2 - np.arange(CLASSES)[:, None])).sum() / max(n.sum(), 1e-12)
    return pd.DataFrame({"annotator": pdf["annotator"].iloc[:1].to_numpy(), "labels": [int(round(n.sum()))], "reliability": [m], "low": [low], "high": [high], "offset": [float(offset)]})


class Consensus:
    """The fitted model of a table of annotations."""

    def __init__(self, annotations: DataFrame, rounds: int = ROUNDS) -> None:
        self.labels = materialize(latest_labels(annotations), "labels")
        self.rounds, self.converged = 0, False
        self.posterior, self.annotators = self._fit(rounds)
        if not self.converged:
            logging.getLogger(__name__).warning("the consensus model has not converged in %d rounds", self.rounds)
        self.careful = self._careful()

    def _careful(self) -> float:
        """Expected accuracy that parts careful annotators from others; from at most 1001 sums of labels."""
        place = F.floor(F.col("reliability") * 1000)
        sums = self.annotators.groupBy(place.alias("place")).agg(F.sum("labels").alias("labels")).orderBy("place").collect()
        cut = two_groups(np.array([r.place / 1000 for r in sums], float), np.array([r.labels for r in sums], float))
        return ONE_GROUP if cut is None else cut

    def _counts(self, posterior: DataFrame) -> DataFrame:
        joined = self.labels.join(posterior, "item")
        return joined.groupBy("annotator", "symbol").agg(*[F.sum(f"q{k}").alias(f"n{k}") for k in range(CLASSES)])

    def _fit(self, rounds: int) -> tuple[DataFrame, DataFrame]:
        k_ = range(CLASSES)
        # start: the share of each whole number among the item's labels, half points split, with a little of everything
        near = lambda k: F.when(F.col("symbol") == 2 * k, 1.0).when(F.abs(F.col("symbol") - 2 * k) == 1, 0.5).otherwise(0.0)
        votes = self.labels.groupBy("item").agg(*[(F.sum(near(k)) + 0.1).alias(f"v{k}") for k in k_])
        total = sum((F.col(f"v{k}") for k in k_), F.lit(0.0))
        posterior = votes.select("item", *[(F.col(f"v{k}") / total).alias(f"q{k}") for k in k_])
        kind = dict(self.labels.dtypes)["annotator"]
        schema = f"annotator {kind}, labels long, reliability double, low double, high double, offset double"
        before, old = None, []
        for _ in range(rounds):
            self.rounds += 1
            counts = materialize(self._counts(posterior), "counts")
            sums = counts.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0.0)).alias(f"n{k}") for k in k_]).first()
            nu = CLASS_PRIOR + np.array([sums[f"n{k}"] for k in k_])
            prior_logs = digamma(nu) - digamma(nu.sum())
            logs = materialize(_expected_logs(counts), "logs")
            scored = self.labels.join(logs, ["annotator", "symbol"]).groupBy("item").agg(*[F.sum(f"e{k}").alias(f"e{k}") for k in k_])
            posterior = scored.select("item", *[q.alias(f"q{k}") for k, q in enumerate(_softmax([F.col(f"e{k}") + float(prior_logs[k]) for k in k_]))])
            now = materialize(counts.groupBy("annotator").applyInPandas(_accuracy, schema), "annotators")
            if before is not None:
                joined = now.select("annotator", "reliability").join(before.select("annotator", F.col("reliability").alias("was")), "annotator")
                change = joined.agg(F.max(F.abs(F.col("reliability") - F.col("was")))).first()[0]
                if change is None or change < CHANGE:
                    self.converged = True
                    break
            # the tables of the iteration before the last are read by nothing any more
            release(*old)
            old, before = [counts, logs] + ([before] if before is not None else []), now
        return materialize(posterior, "posterior"), now

    def items(self, least: int = LEAST, careful: float | None = None) -> DataFrame:
        """(item, label, posterior, careful, annotators, agreement): the consensus of each item."""
        rated = self.labels.join(self.annotators.select("annotator", (F.col("reliability") >= (self.careful if careful is None else careful)).alias("careful")), "annotator")
        whole = F.when(F.col("careful") & (F.col("symbol") % 2 == 0), F.col("symbol") / 2)
        votes = rated.groupBy("item").agg(
            *[F.count_if(whole == k).alias(f"c{k}") for k in range(CLASSES)],
            F.count("*").alias("annotators"), F.count_if("careful").alias("careful"),
        )
        joined = votes.filter(F.col("annotators") >= least).join(self.posterior, "item")
        best = F.greatest(*[F.struct(F.col(f"c{k}").alias("c"), F.col(f"q{k}").alias("q"), F.lit(-k).alias("k")) for k in range(CLASSES)])
        out = joined.select("item", best.alias("b"), "annotators", "careful", F.array(*[f"q{k}" for k in range(CLASSES)]).alias("q"))
        label = (-F.col("b.k")).cast("int")
        return out.select(
            "item", label.alias("label"), F.element_at("q", label + 1).alias("posterior"), "careful", "annotators",
            F.coalesce(F.try_divide(F.col("b.c"), F.col("careful")), F.lit(0.0)).alias("agreement"),
        )

    def krippendorff(self, by: str | None = None) -> DataFrame:
        """(labels, alpha) or (by, labels, alpha): agreement beyond chance, interval differences.

        Observed disagreement is within items, expected disagreement over all labels; both come from sums,
        sums of squares and counts, so no pairs are made.  ``by`` is 'all' or 'careful'.
        """
        x = F.col("symbol") / 2
        labels = self.labels if by != "careful" else self.labels.join(self.annotators.filter(F.col("reliability") >= self.careful).select("annotator"), "annotator")
        per = labels.groupBy("item").agg(F.count("*").alias("m"), F.sum(x).alias("s"), F.sum(x * x).alias("ss")).filter("m > 1")
        # sum over ordered pairs of (a - b)^2 = 2 (m ss - s^2)
        sums = per.agg(
            F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
            F.sum(2 * (F.col("m") * F.col("ss") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("within"),
        )
        observed = F.try_divide("within", "n")
        expected = F.try_divide(2 * (F.col("n") * F.col("ss") - F.col("s") * F.col("s")), F.col("n") * (F.col("n") - 1))
        return sums.filter("n > 0").select(F.lit(by or "all").alias("raters"), F.col("n").alias("labels"), F.when(expected > 0, 1 - observed / expected).alias("alpha"))


def found(annotations: DataFrame) -> DataFrame:
    """(item_id, label)."""
    return Consensus(annotations).items().select(F.col("item").alias("item_id"), "label")


def item_report(annotations: DataFrame) -> DataFrame:
    """(item_id, label, posterior, careful, annotators, agreement)."""
    out = Consensus(annotations).items().withColumnRenamed("item", "item_id")
    return out.withColumn("posterior", F.round("posterior", 4)).withColumn("agreement", F.round("agreement", 4))


def annotator_report(annotations: DataFrame, annotators: DataFrame) -> DataFrame:
    """(annotator_id, stored, labels, reliability, low, high, offset): all annotators, those without labels with nulls."""
    fitted = Consensus(annotations).annotators
    stored = annotators.select(F.col("id").alias("annotator"), F.col("reliability").alias("stored")).distinct()
    out = stored.join(fitted, "annotator", "full_outer")
    return out.select(F.col("annotator").alias("annotator_id"), "stored", F.coalesce("labels", F.lit(0).cast("long")).alias("labels"), *[F.round(c, 4).alias(c) for c in ("reliability", "low", "high", "offset")])


def agreement_report(annotations: DataFrame) -> DataFrame:
    """(raters, labels, alpha, cut, rounds, converged): Krippendorff's alpha of all annotators and of the careful ones,
    the cut between careful ones and others, and how the model's fit ended."""
    model = Consensus(annotations)
    out = model.krippendorff("all").unionByName(model.krippendorff("careful")).withColumn("alpha", F.round("alpha", 6))
    return out.select("raters", "labels", "alpha", F.round(F.lit(model.careful), 4).alias("cut"), F.lit(model.rounds).alias("rounds"), F.lit(model.converged).alias("converged"))
