"""Mixing sources to target weights by soft membership, in DataFrame operations only.

From labelled documents a classifier learns which words and binned measures tell a domain from the others (one half of them), and a
multinomial logistic regression over the hits on these and a few measures of the text (the other half). It gives each document
a posterior of its own, p_i. Document i of n_i tokens then gets a rate r_i >= 0 such that the expected token totals sum(r_i n_i p_i)
meet the targets in the least-squares sense of their relative gaps.

The rates come from projected gradient steps over all documents: r <- max(0, r - q . e), q the posterior by the target totals.
Each step is one distributed aggregate: it gives the totals S(r) and the Gram matrix of the rates above zero, of
which the driver makes the next direction e (damped, as the Gram matrix alone may be singular; with much damping e is the plain
gradient). A step that does not lessen the gap is taken back and damped more. What the driver holds is three numbers
a step; a rate is the fold of the steps over the document's posterior, so no table of rates has to be kept or joined.

The target totals are such that the first domain keeps the expected tokens it has, so documents that are surely of it have rates near one.
A target smaller than what the classifier can tell apart is raised to it, see feasible(): else least squares would leave few documents with high rates.
Whole copies of a document are floor(rate + u), u uniform in [0, 1) by its hashed id and text: the expectation is the rate.

Defined results: a null or empty text has no tokens and the posterior of a text without telling features. Very long texts are cut
into words in the one row that holds them. Without labels, or with too few to fit, the posteriors are a third each; with labels of one domain only, its
posterior is one; in both cases every rate is one, as nothing can be told apart.
Null labels are not used; of repeated labels of an id the lowest quality and highest toxicity count. Repeated rows get equal
rates and copies, and ties cannot arise. Columns of the documents keep their names; mix() packs them away while it works. No documents give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routinelens.storage import materialise

DOMAINS = ("good", "low", "toxic")
#: The share of all tokens that each domain is to have, if it can be told apart so far.
TARGETS = {"good": 0.98, "low": 0.015, "toxic": 0.005}
#: What of the first domain's expected tokens may be lost to reach a target, and steps a power of ten of the ratios by which feasible() orders documents.
LOSS, STEPS = 0.02, 40
#: At most this many labelled documents, those whose hashed ids come first, take part in the fit.
MAX_LABELLED = 20_000
#: A domain's telling features: at most this many, each in so many of its labelled documents, so many times as
#: frequent there as elsewhere, and with this G statistic.
MAX_FEATURES, MIN_DOCUMENTS, MIN_LIFT, MIN_G = 256, 3, 5.0, 10.0
#: Ridge of the regression, as the library scales it.
RIDGE = 1e-4
#: The largest relative gap to a target, or the largest projected gradient, at which the steps end; more passes than feasible targets need.
TOLERANCE, MAX_PASSES = 1e-6, 80
#: Decimal places of a step, so that the order of summation does not show in the rates.
PLACES = 10
SEED = 17
_WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The columns that the posterior depends on.
MEASURES = ("x_low", "x_toxic", "x_low_share", "x_toxic_share", "x_length", "x_distinct", "x_marks", "x_calls")


def features(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """The kept columns, n_tokens, the distinct features of the text (words and binned measures) and the measures themselves."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(
        *keep,
        F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)).alias("w"),
        F.regexp_count(text, F.lit("[#$%&|<>]")).alias("marks"),
        F.regexp_count(text, F.lit("!")).alias("calls"),
    )
    cut = cut.withColumn("d", F.array_distinct("w"))
    n = F.greatest(F.size("w"), F.lit(1))
    bins = [("distinct", F.floor(10 * F.size("d") / n)), ("marks", F.least(F.lit(9), F.ceil(20 * F.col("marks") / n))), ("calls", F.least(F.lit(9), F.ceil(20 * F.col("calls") / n)))]
    names = [c for c in cut.columns if c not in ("w", "marks", "calls", "d")]
    return cut.select(
        *names,
        F.size("w").cast("long").alias("n_tokens"),
        F.size("d").alias("n_distinct"),
        F.concat("d", F.array(*[F.concat(F.lit(f"<{k} "), b.cast("string"), F.lit(">")) for k, b in bins])).alias("features"),
        F.log1p(F.size("w").cast("double")).alias("x_length"),
        (F.size("d") / n).alias("x_distinct"),
        F.log1p(F.col("marks") / n * 20).alias("x_marks"),
        F.log1p(F.col("calls") / n * 20).alias("x_calls"),
    )


def measured(found: DataFrame, telling: tuple[tuple[str, ...], ...]) -> DataFrame:
    """From rows of features(): the kept columns, n_tokens and MEASURES, with the hits on telling features."""
    hits = {d: F.size(F.array_intersect("features", F.array(*map(F.lit, names)).cast("array<string>"))) for d, names in zip(DOMAINS[1:], telling)}
    made = {f"x_{d}": F.log1p(h.cast("double")) for d, h in hits.items()} | {f"x_{d}_share": h / F.sqrt(F.col("n_distinct") + 1.0) for d, h in hits.items()}
    dropped = {"features", "n_distinct", *MEASURES}
    return found.select(*[c for c in found.columns if c not in dropped], *[(made[m] if m in made else F.col(m)).alias(m) for m in MEASURES])


@dataclass(frozen=True)
class Classifier:
    """The telling features of each domain but the first, and by domain the regression's weights of MEASURES and its intercept."""

    telling: tuple[tuple[str, ...], ...]
    weights: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]
    #: Without a fit, the posteriors of all documents.
    fixed: tuple[float, ...] | None = None

    def posteriors(self) -> list[Column]:
        """The chance of each domain, from the columns MEASURES."""
        if self.fixed:
            return [F.lit(p) for p in self.fixed]
        score = [sum((F.col(m) * w for m, w in zip(MEASURES, row) if w), F.lit(b)) for row, b in zip(self.weights, self.intercepts)]
        top = F.greatest(*score)
        odds = [F.exp(z - top) for z in score]
        return [o / sum(odds[1:], odds[0]) for o in odds]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> Classifier:
    """Learn from at most ``limit`` labelled documents: the features from one half, the regression from the other.

    What is collected is bounded by MAX_FEATURES.
    """
    kinds = range(len(DOMAINS))
    marks = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("labelled_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    domain = F.when(F.col("t") == 1, 2).when(F.col("q") == 0, 1).otherwise(0)
    chosen = marks.select("labelled_id", domain.alias("domain")).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(limit)
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("labelled_id"))
    half = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(2)).alias("half")
    rows = materialise(features(some, "text", [F.col("domain"), half]), "labelled-features")
    by, seen = ({r["domain"]: r["n"] for r in found if r["half"] == half} for found in [rows.groupBy("half", "domain").agg(F.count(F.lit(1)).alias("n")).collect()] for half in (0, 1))
    sizes = [by.get(k, 0) for k in kinds]
    if len(seen) < 2:
        only = {*by, *seen}
        return Classifier(tuple(() for _ in kinds[1:]), (), (), tuple(float(k in only) for k in kinds) if len(only) == 1 else tuple(1 / len(DOMAINS) for _ in kinds))
    total = sum(sizes)
    counts = rows.filter("half = 0").select("domain", F.explode("features").alias("f")).groupBy("f").agg(*[F.count_if(F.col("domain") == k).alias(f"c{k}") for k in kinds], F.count(F.lit(1)).alias("c"))
    telling = []
    for k in kinds[1:]:
        own, other = F.col(f"c{k}"), F.col("c") - F.col(f"c{k}")
        p, q = (own + 0.5) / (sizes[k] + 1.0), (other + 0.5) / (total - sizes[k] + 1.0)
        share = (F.col("c") + 0.5) / (total + 1.0)
        g = 2 * (own * F.log(p / share) + (sizes[k] - own) * F.log((1 - p) / (1 - share)) + other * F.log(q / share) + (total - sizes[k] - other) * F.log((1 - q) / (1 - share)))
        best = counts.filter((own >= MIN_DOCUMENTS) & (p >= MIN_LIFT * q)).withColumn("g", g).filter(F.col("g") >= MIN_G).orderBy(F.desc("g"), "f").limit(MAX_FEATURES)
        telling.append(tuple(sorted(r["f"] for r in best.select("f").collect())))
    train = materialise(measured(rows.filter("half = 1"), tuple(telling)), "labelled-measures")
    none = tuple(0.0 for _ in MEASURES)
    vectors = VectorAssembler(inputCols=list(MEASURES), outputCol="x").transform(train.withColumn("domain", F.col("domain").cast("double")))
    made = LogisticRegression(featuresCol="x", labelCol="domain", family="multinomial", regParam=RIDGE, maxIter=100).fit(vectors)
    rows_of, cuts = made.coefficientMatrix.toArray(), made.interceptVector.toArray()
    known = [k in seen and k < len(cuts) for k in kinds]
    absent = float(min(cuts)) - 30.0  # a domain without labelled documents has next to no chance
    return Classifier(tuple(telling), tuple(tuple(map(float, rows_of[k])) if known[k] else none for k in kinds), tuple(float(cuts[k]) if known[k] else absent for k in kinds))


Step = tuple[float, ...]


def rates(steps: list[Step], posterior: list[Column]) -> Column:
    """The rate after the steps: from one, each takes its product with the posterior away, and none goes below zero."""
    if not steps:
        return F.lit(1.0)
    p = F.array(*posterior)
    fold = lambda r, e: F.greatest(F.lit(0.0), r - (e[0] * p[0] + e[1] * p[1] + e[2] * p[2]))
    return F.aggregate(F.array(*[F.array(*map(F.lit, e)) for e in steps]), F.lit(1.0), fold)


def _totals(members: DataFrame, steps: list[Step]) -> tuple[np.ndarray, np.ndarray]:
    """The expected tokens of each domain at the rates, and the Gram matrix of the rows whose rate is above zero."""
    names = [f"p_{d}" for d in DOMAINS]
    rows = members.select("n_tokens", *names, rates(steps, [F.col(c) for c in names]).alias("r"))
    n, free = F.col("n_tokens").cast("double"), F.when(F.col("r") > 0, F.col("n_tokens").cast("double")).otherwise(0.0)
    k = range(len(names))
    sums = [F.sum(n * F.col("r") * F.col(c)).alias(f"s{i}") for i, c in enumerate(names)] + [F.sum(free * F.col(names[i]) * F.col(names[j])).alias(f"a{i}{j}") for i in k for j in k if i <= j]
    row = rows.agg(*sums).first()
    value = lambda c: float(row[c] or 0.0)
    return np.array([value(f"s{i}") for i in k]), np.array([[value(f"a{min(i, j)}{max(i, j)}") for j in k] for i in k])


def _steepest(members: DataFrame, steps: list[Step], slope: Step) -> float:
    """The largest projected gradient of any row: what a rate above zero may go either way, one at zero only up."""
    names = [F.col(f"p_{d}") for d in DOMAINS]
    g = sum((F.lit(s) * c for s, c in zip(slope, names)), F.lit(0.0))
    r = rates(steps, names)
    row = members.filter("n_tokens > 0").select(F.when(r > 0, F.abs(g)).otherwise(F.greatest(F.lit(0.0), -g)).alias("g")).agg(F.max("g")).first()
    return float(row[0] or 0.0)


def feasible(members: DataFrame, targets: dict[str, float]) -> dict[str, float]:
    """The targets, none smaller than the share that its domain keeps when the documents most like it go, until ``LOSS`` of the first domain's tokens are gone.

    Documents are ordered by the ratio of the two posteriors, in steps whose number does not depend on the input. One aggregate a domain.
    """
    first = DOMAINS[0]
    made = {first: 1.0}
    for d in DOMAINS[1:]:
        ratio = F.log10(F.greatest(F.col(f"p_{d}"), F.lit(1e-12)) / F.greatest(F.col(f"p_{first}"), F.lit(1e-12)))
        n = F.col("n_tokens").cast("double")
        steps = members.groupBy(F.floor(ratio * STEPS).alias("step")).agg(F.sum(n * F.col(f"p_{first}")).alias("kept"), F.sum(n * F.col(f"p_{d}")).alias("own")).orderBy("step").collect()
        least, kept, own = (1 - LOSS) * sum(r["kept"] for r in steps), 0.0, 0.0
        for r in steps:
            kept, own = kept + r["kept"], own + r["own"]
            if kept >= least:
                break
        wanted = targets[d] / targets[first] if targets[first] else math.inf
        made[d] = max(wanted, own / kept) if kept > 0 else wanted
    if not all(map(math.isfinite, made.values())) or all(made[d] == targets[d] / targets[first] for d in DOMAINS[1:]):
        return targets
    whole = sum(made.values())
    return {d: x / whole for d, x in made.items()}


def solve(members: DataFrame, targets: dict[str, float] = TARGETS) -> list[Step]:
    """The steps that lead the rates of rows (n_tokens, p_good, p_low, p_toxic) from one to the least squared relative gaps."""
    have, gram = _totals(members, [])
    if have.sum() <= 0:
        return []
    want = np.array([targets[d] for d in DOMAINS], float)
    want = want / want[0] * have[0] if want[0] > 0 and have[0] > 0 else want / want.sum() * have.sum()
    scale = np.maximum(want, 1e-6 * have.sum())  # a target of zero tokens has a gap too
    gap = lambda s: (s - want) / scale
    steps: list[Step] = []
    off, damping = gap(have), 1e-9
    for _ in range(MAX_PASSES):
        if np.abs(off).max() <= TOLERANCE:
            break
        metric = gram / np.outer(scale, scale)
        lead = float(np.trace(metric))
        e = np.linalg.solve(metric + damping * lead * np.eye(len(want)), off) / scale
        step = tuple(round(float(x), PLACES) for x in e)
        tried, tried_gram = _totals(members, [*steps, step])
        before, after = float(off @ off), float(gap(tried) @ gap(tried))
        if after < before:
            steps.append(step)
            off, gram = gap(tried), tried_gram
            damping = max(damping / 10, 1e-9)
        else:
            damping *= 100
        if after >= before * 0.999:  # next to no gain: at the optimum of targets out of reach?
            slope = tuple(float(x) for x in off / scale * have.sum())
            if damping > 1e6 or _steepest(members, steps, slope) <= TOLERANCE * float(np.abs(slope).max()):
                break
    return steps


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, p_good, p_low, p_toxic, rate and copies."""
    model = fit(docs, labels, id_col, text_col)
    held = materialise(measured(features(docs, text_col, [F.col(id_col).alias("id"), _key(id_col, text_col)]), model.telling), "memberships")
    posterior = [p.alias(f"p_{d}") for p, d in zip(model.posteriors(), DOMAINS)]
    members = held.select("id", "key", "n_tokens", *posterior)
    steps = [] if model.fixed else solve(members, feasible(members, targets))
    rated = members.withColumn("rate", rates(steps, [F.col(f"p_{d}") for d in DOMAINS]))
    return rated.select(F.col("id").alias(id_col), "n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", _copies(F.col("key"), F.col("rate")).alias("copies"))


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col)).alias("key")


def copies(id_: Column, text: Column, rate: Column) -> Column:
    """How often a document of that id and text comes; the same for equal rows, and of one null id not the same for all texts."""
    return _copies(F.xxhash64(F.lit(SEED), id_, text), rate)


def _copies(key: Column, rate: Column) -> Column:
    u = F.pmod(key, F.lit(1 << 53)) / float(1 << 53)
    return F.floor(rate + u)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, each as often as its copies, with all their columns.

    Rows and measures are written once; the steps read the measures' columns only. Texts are not shuffled.
    """
    model = fit(docs, labels, id_col, text_col)
    found = features(docs, text_col, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(id_col, text_col)])
    held = materialise(measured(found, model.telling), "memberships")
    posterior = [p.alias(f"p_{d}") for p, d in zip(model.posteriors(), DOMAINS)]
    members = held.select("n_tokens", *posterior)
    steps = [] if model.fixed else solve(members, feasible(members, targets))
    rated = held.select("row", "key", *posterior).withColumn("rate", rates(steps, [F.col(f"p_{d}") for d in DOMAINS]))
    times = rated.select("row", _copies(F.col("key"), F.col("rate")).cast("int").alias("times"))
    return times.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")
