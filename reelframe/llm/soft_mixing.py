"""Mixing sources to target weights by soft membership.

A classifier learnt from a table of labels gives every document a posterior over
domains; the document's tokens belong to the domains in these shares.  Projected
gradient descent on a least-squares problem then finds nonnegative rates, how often to
use each document, whose expected tokens by domain match the targets: with S_k the sum
of rate x tokens x posterior_k and T_k the target,

    sum_k (S_k - T_k)^2 / (T x mass_k)  +  RIDGE x sum of tokens x (rate - 1)^2,

mass_k the domain's tokens at rate 1 and T the whole.  The second term is small and
picks, of all rates that match, those next to 1.  Rates have no upper bound: a rare
domain gets what its target takes.

At the least value, rate = max(0, 1 + posterior . pull), one pull per domain.  Each step
moves the pulls along the gradient, scaled by the second derivatives over the documents
whose rate is not 0, and projects the rates onto >= 0; a step is halved until it descends.
Steps go on until the gradient vanishes, or nothing descends any more; ``STEPS`` of them
that end otherwise count as a target missed.  If a
target is then missed by more than ``NEAR`` of itself, the second term is made smaller,
down to ``LEAST_RIDGE``.  Where that does not reach it either, no sensible rates match: the rates are
those at RIDGE, ``targets_met`` is false in every row, and a warning gives the shares.

The classifier is naive Bayes with Gaussian features of the text (share of symbols,
capitals, blanks and stops, distinct lines), its log odds divided by ``TEMPER``
because the features depend on each other.  Its parameters are one aggregate of the
labelled rows.  Posteriors are rounded to multiples of 1 / ``GRID``; documents with one
rounded posterior share a rate, so the sums of a step run over the documents
summed up by posterior beforehand, a number of rows that ``GRID`` and the domains bound.

Only DataFrame functions are used: no Python runs on the executors.

Nulls and odd input: a null or empty text has 0 tokens, the posterior its features
give, and the rate of that posterior; without labels all posteriors are equal; labels
with null id or label are left out, repeated ones count once (the largest); a domain
without labelled documents gets posterior 0; repeated rows get equal rates and
copies; a null id is never labelled; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import Scratch, read
from reelframe.llm.length_buckets import word_count

GRID, TEMPER, RIDGE = 256, 3.0, 1e-4
LEAST_RIDGE, NEAR = 1e-10, 1e-3
STEPS, CLOSE = 40, 1e-7
SMALL = 100_000  # rows of rates that are sent to all executors at most
#: Share of the tokens that each value of labels.quality is to have.
TARGETS = {0: 0.05, 1: 0.95}
SYMBOLS = "#*%$&|=+<>{}[]_~^!?"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FLOOR = 0.004  # least standard deviation of a feature


def features(text: Column) -> list[Column]:
    """Shares between 0 and 1 that tell prose from lists, noise and shouting."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    share = lambda chars: (n - F.length(F.translate(t, chars, ""))) / (n + 1)
    lines = F.split(t, "\n")
    return [share(SYMBOLS), share(CAPITALS), share(" "), share(".,"), F.size(F.array_distinct(lines)) / F.size(lines)]


def fit(featured: DataFrame, labels: DataFrame, id_col: str, label_col: str, domains: list) -> list[tuple | None]:
    """Per domain its log prior, means and deviations; None for one without rows."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).alias("label"))
    x = [c for c in featured.columns if c.startswith("__x")]
    rows = featured.join(own, "__id").where(F.col("label").isin(domains)).groupBy("label").agg(F.count("*").alias("n"), *(f(c).alias(f"{a}_{c}") for c in x for f, a in ((F.avg, "m"), (F.stddev_pop, "s")))).collect()
    total = sum(r["n"] for r in rows)
    by = {r["label"]: (math.log(r["n"] / total), [r[f"m_{c}"] for c in x], [max(FLOOR, r[f"s_{c}"]) for c in x]) for r in rows}
    return [by.get(d) for d in domains]


def posterior(x: list[Column], model: list[tuple | None]) -> Column:
    """Posteriors by domain as whole multiples of 1 / GRID (array of int)."""
    if not any(model):
        return F.array(*(F.lit(GRID) for _ in model))
    logs = []
    for m in model:
        if m is None:
            logs.append(F.lit(-1e9))
            continue
        prior, mean, sd = m
        terms = [-((c - F.lit(a)) * (c - F.lit(a))) / F.lit(2 * s * s) - F.lit(math.log(s)) for c, a, s in zip(x, mean, sd, strict=True)]
        logs.append((F.lit(prior) + sum(terms[1:], terms[0])) / F.lit(TEMPER))
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    e = [F.exp(v - top) for v in logs]
    return F.array(*(F.round(v / sum(e[1:], e[0]) * GRID).cast("int") for v in e))


def share(p: Column, k: int) -> Column:
    return F.get(p, F.lit(k)) / F.greatest(F.lit(1), F.aggregate(p, F.lit(0), lambda s, v: s + v))


def rate(p: Column, pulls: list[float]) -> Column:
    """The rate of a posterior: nonnegative, 1 without pulls."""
    return F.greatest(F.lit(0.0), sum((share(p, k) * F.lit(float(v)) for k, v in enumerate(pulls)), F.lit(1.0)))


def solve(cells: DataFrame, targets: list[float]) -> tuple[list[float], list[float], bool]:
    """Pulls, expected shares of the tokens, and whether these are the targets; cells: p, tokens."""
    k = len(targets)
    part = [share(F.col("p"), i) for i in range(k)]
    first = cells.agg(*(F.sum(F.col("tokens") * c).alias(f"s{i}") for i, c in enumerate(part)), F.sum("tokens").alias("t")).first()
    whole = float(first["t"] or 0)
    if not whole:
        return [0.0] * k, [0.0] * k, True
    mass = np.array([float(first[f"s{i}"]) / whole for i in range(k)])
    goal = np.array(targets, float) / sum(targets)
    # a domain without tokens cannot be matched and gives no direction
    live = [i for i in range(k) if mass[i] > 0]
    pairs = [(a, b) for a in range(len(live)) for b in range(a + 1)]
    m, g = mass[live], goal[live]

    def look(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Half the weighted squares of the rates, the domains' shares, and the shares' derivatives."""
        pulls = np.zeros(k)
        pulls[live] = x
        held = cells.select((F.col("tokens") / F.lit(whole)).alias("w"), rate(F.col("p"), pulls).alias("r"), *(part[i].alias(f"p{a}") for a, i in enumerate(live)))
        w, r, p = F.col("w"), F.col("r"), [F.col(f"p{a}") for a in range(len(live))]
        row = held.agg(F.sum(w * r * r / 2), *(F.sum(w * r * c) for c in p), *(F.sum(F.when(r > 0, w * p[a] * p[b]).otherwise(F.lit(0.0))) for a, b in pairs)).first()
        second = np.zeros((len(live), len(live)))
        for (a, b), v in zip(pairs, row[1 + len(live) :], strict=True):
            second[a, b] = second[b, a] = v
        return row[0], np.array(row[1 : 1 + len(live)]), second

    def met(s: np.ndarray) -> bool:
        return bool(len(live) == np.count_nonzero(goal + mass) and np.all(np.abs(s - g) <= NEAR * np.where(g > 0, g, m)))

    def descend(x: np.ndarray, now: tuple, ridge: float) -> tuple[np.ndarray, tuple]:
        for _ in range(STEPS):
            gradient = now[1] + ridge * m * x - g
            if np.max(np.abs(gradient) / m) < CLOSE:
                break
            move = -np.linalg.lstsq(now[2] + ridge * np.diag(m), gradient, rcond=None)[0]
            value, size = now[0] + ridge * (m @ (x * x)) / 2 - g @ x, 1.0
            while size > 1e-4:
                then = look(to := x + size * move)
                if then[0] + ridge * (m @ (to * to)) / 2 - g @ to < value + 1e-4 * size * (gradient @ move):
                    break
                size /= 4
            else:
                break  # the numbers' precision ends here
            x, now = to, then
        return x, now

    x, now = descend(np.zeros(len(live)), look(np.zeros(len(live))), RIDGE)
    at_ridge, ridge = (x, now), RIDGE
    while not met(now[1]) and ridge > LEAST_RIDGE:
        ridge /= 100
        x, now = descend(x, now, ridge)
    if not met(now[1]):
        x, now = at_ridge
    pulls, shares = np.zeros(k), np.zeros(k)
    pulls[live], shares[live] = x, now[1]
    if not met(now[1]):
        warnings.warn(f"the rates miss the targets {goal.tolist()}: expected shares are {shares.tolist()}", stacklevel=2)
    return pulls.tolist(), shares.tolist(), met(now[1])


def draw(id_col: Column, r: Column) -> Column:
    """Whole copies whose mean over ids is the rate: the fraction is drawn by a hash of the id."""
    u = F.pmod(F.xxhash64(id_col, F.lit("mix")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(r + u).cast("int")


def mix(documents: DataFrame, labels: DataFrame, *, labelled: DataFrame | None = None, targets: dict | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (the id if none) with n_tokens, posterior, rate, copies and targets_met.

    labels: id and label; targets: share of the tokens for each label.  posterior
    follows the order of the targets' labels.  labelled: the table that the labelled
    ids belong to, if it is not ``documents``.
    """
    targets = targets or TARGETS
    domains, keep = sorted(targets), keep or [id_col]
    scratch = Scratch(documents.sparkSession, "soft-mixing")

    def featured(df: DataFrame, *more: Column) -> DataFrame:
        x = features(F.col(text_col))
        return df.select(F.col(id_col).cast("long").alias("__id"), *more, *(c.alias(f"__x{i}") for i, c in enumerate(x)))

    tokens = word_count(F.col(text_col)).alias("__tokens")
    # texts are read once: what the result needs of a row is written beside its features
    held = scratch.keep(featured(documents, tokens, *(F.col(c).alias(f"__keep_{c}") for c in keep)), "features")
    narrow = held.select(*(c for c in held.columns if not c.startswith("__keep_")))
    x = [F.col(c) for c in narrow.columns if c.startswith("__x")]
    model = fit(narrow if labelled is None else featured(labelled), labels, id_col, label_col, domains)
    cells = scratch.keep(narrow.groupBy(posterior(x, model).alias("p")).agg(F.sum("__tokens").alias("tokens")), "cells")
    pulls, _, reached = solve(cells, [targets[d] for d in domains])

    # a rate for each posterior; at most as many rows as the grid has points, C(GRID + domains - 1, domains - 1)
    rates = cells.select("p", F.round(rate(F.col("p"), pulls), 9).alias("__rate"))
    rates = F.broadcast(rates) if cells.count() <= SMALL else rates
    own = held.withColumn("p", posterior(x, model)).join(rates, "p")
    part = F.transform("p", lambda v: v / F.lit(GRID)).alias("posterior")
    return own.select(*(F.col(f"__keep_{c}").alias(c) for c in keep), F.col("__tokens").alias("n_tokens"), part, F.col("__rate").alias("rate"), draw(F.col("__id"), F.col("__rate")).alias("copies"), F.lit(reached).alias("targets_met"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
