"""Logistic rankers over candidate features: training rows, standardized fit, scoring as one SQL expression."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import EVENT_TYPES
from ..functions.ranks import cut, first_n
from .fusion import COMPONENTS, FEATURES, Order, Ranks, any_of, best_items, null_places, position_columns, share_of, union_of

#: Newton steps at most, and the gradient below which they end.
MAX_STEPS, TOLERANCE = 100, 1e-9


def _chance(of: Callable[[str], Column], mean: Sequence[float | Column], deviation: Sequence[float | Column], coefficients: Sequence[float | Column], intercept: Column) -> Column:
    terms = [c * (of(f) - m) / d for f, m, d, c in zip(FEATURES, mean, deviation, coefficients, strict=True)]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, intercept)))


def held_score(model: Column, of: Callable[[str], Column]) -> Column:
    """Model.score() of a row's own model, see Model.held(): the same sum, in code that is as long for many models as for one."""
    return _chance(of, *[[model[f"{n}{i}"] for i in range(len(FEATURES))] for n in "mdc"], model["b"])


@dataclass(frozen=True)
class Model:
    """Means and deviations of the features, and coefficients of the standardized ones."""

    mean: tuple[float, ...]
    deviation: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def score(self, of: Callable[[str], Column] = F.col) -> Column:
        return _chance(of, self.mean, self.deviation, self.coefficients, F.lit(self.intercept))

    def held(self) -> Column:
        """Its numbers as a structure, which held_score() reads."""
        numbers = {"b": self.intercept} | {f"{n}{i}": v for n, of in (("m", self.mean), ("d", self.deviation), ("c", self.coefficients)) for i, v in enumerate(of)}
        return F.struct(*[F.lit(float(v)).alias(n) for n, v in numbers.items()])

    def named(self) -> dict[str, float]:
        return dict(zip(FEATURES, self.coefficients, strict=True))


def feature_of(item: Column) -> Callable[[str], Column]:
    """The features of an item of fusion.items_of(), by name."""
    return lambda f: item[f"s_{f.removesuffix('_rr')}"] if f.endswith("_rr") else item[f"r_{f.removesuffix('_present')}"].isNotNull().cast("double")


def feature_at(of: Ranks, share: Ranks) -> Callable[[str], Column]:
    """The features of an item by name, from its ranks and shares."""
    return lambda f: share(f.removesuffix("_rr")) if f.endswith("_rr") else of(f.removesuffix("_present")).isNotNull().cast("double")


def learned_order(cells: Sequence[tuple[Column, Model]]) -> Order:
    """The order of ranked_items() by the model of the first cell whose condition a positive's row meets. The model is picked once for a positive and stands in its row beside its candidates."""
    (on, first), *rest = [(on, m.held()) for on, m in cells]
    # rows that no cell asks for are given a model as well, so that none is null
    model = reduce(lambda x, cell: x.when(*cell), rest, F.when(on, first)).otherwise(first)
    return Order(lambda of: reduce(Column.__or__, [of(n).isNotNull() for n in COMPONENTS]), lambda of, share, held: [-held_score(held, feature_at(of, share))], reduce(Column.__or__, [on for on, _ in cells]), model)


def ranked_items(items: Column, model: Model, k: int) -> Column:
    """The first k items by the model's score, filled up by the fallback list."""
    return best_items(items, lambda x: [-model.score(feature_of(x))], any_of(COMPONENTS), k)


def training_rows(features: DataFrame, positives: DataFrame, task: str, max_nonrelevant: int, stage: str | None = None) -> DataFrame:
    """Features and label of all retrieved positives, and of the first other items by number, of queries with a retrieved positive."""
    keys = [c for c in ("split", "query_id", "stage") if c in features.columns]
    wanted = positives.where(F.col("task") == task)
    if stage:
        wanted, features = wanted.where(F.col("stage") == stage), features.where(F.col("stage") == stage)
    labelled = features.join(wanted.select(*keys, "itemid", F.lit(1).alias("label")), [*keys, "itemid"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    rows = labelled.withColumn("found", F.max("label").over(Window.partitionBy(*keys))).where("found = 1").drop("found")
    placed = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "label").orderBy("itemid")))
    return placed.where((F.col("label") == 1) | (F.col("nth") <= max_nonrelevant)).drop("nth")


def counted_rows(rows: DataFrame, max_nonrelevant: int) -> DataFrame:
    """[stage,] task, label, the features and n: how often training_rows() of each task have that label and those features.

    ``rows`` have a query each, with items (see fusion.items_of) and wanted, its positives. Rows of equal features weigh n in a fit, which so rests on as many rows as there are different ones.
    """
    stage = [c for c in ("stage",) if c in rows.columns]

    def of(task: str) -> Column:
        own = F.transform(F.filter("wanted", lambda w: w["task"] == task), lambda w: w["itemid"])
        hit = lambda x: F.coalesce(F.array_contains(own, x["itemid"]), F.lit(False))
        row = lambda label: lambda x: F.struct(F.lit(task).alias("task"), F.lit(label).alias("label"), *[feature_of(x)(f).alias(f) for f in FEATURES])
        others = F.slice(F.sort_array(F.filter("items", lambda x: ~hit(x))), 1, max_nonrelevant)  # by itemid
        found = F.filter("items", hit)
        return F.when(F.size(found) > 0, F.concat(F.transform(found, row(1)), F.transform(others, row(0))))

    tasks = F.inline(F.flatten(F.array_compact(F.array(*[of(t) for t in EVENT_TYPES]))))
    return rows.select(*stage, tasks).groupBy(*stage, "task", "label", *FEATURES).agg(F.count("*").alias("n"))


def counted_candidates(rows: DataFrame, offset: float, max_nonrelevant: int) -> DataFrame:
    """counted_rows() from rows of fusion.gathered() with wanted: the items that train become rows, so ranks, features and counts are compiled code and no item is made a structure in its query's row."""
    stage = [c for c in ("stage",) if c in rows.columns]
    known = rows.select(*stage, "wanted", *[f"l_{n}" for n in COMPONENTS], *null_places(COMPONENTS), union_of(COMPONENTS).alias("_every"))

    def own(task: str) -> Column:
        return F.transform(F.filter("wanted", lambda w: w["task"] == task), lambda w: w["itemid"])

    known = known.select("*", *[own(t).alias(f"_own_{t}") for t in EVENT_TYPES])
    sides = [F.struct(F.lit(t).alias("task"), F.lit(label).alias("label"), items.alias("_items")) for t in EVENT_TYPES for label, items in ((1, F.array_intersect("_every", f"_own_{t}")), (0, F.slice(F.array_except(F.sort_array("_every"), f"_own_{t}"), 1, max_nonrelevant)))]
    asked = [F.when(F.arrays_overlap("_every", f"_own_{t}"), side) for t, side in zip([t for t in EVENT_TYPES for _ in range(2)], sides, strict=True)]
    lists = [f"{c}_{n}" for c in "ln" for n in COMPONENTS]
    each = known.select(*stage, *lists, F.inline(F.array_compact(F.array(*asked)))).select(*stage, "task", "label", *lists, F.explode("_items").alias("_item"))
    placed = each.select(*stage, "task", "label", *position_columns(COMPONENTS, "_item", "q"))
    feature = feature_at(lambda n: F.col(f"q_{n}"), lambda n: share_of(F.col(f"q_{n}"), offset))
    return placed.select(*stage, "task", "label", *[feature(f).alias(f) for f in FEATURES]).groupBy(*stage, "task", "label", *FEATURES).agg(F.count("*").alias("n"))


def fits(counted: DataFrame, names: Sequence[str]) -> dict[str, tuple[Model, int, int]]:
    """By name the model, its rows and its positives: L2 with C = 1, classes weighted to balance, by Newton steps whose sums are computed where the rows are.

    ``counted`` has model, label, the features and n, the number of such rows. All models take their steps together, one job a step, until each has settled.
    """
    spark = counted.sparkSession
    counted = cut(counted.groupBy("model", "label", *FEATURES).agg(F.sum("n").alias("n")))
    weighted = [c for f in FEATURES for c in (F.min(f).alias(f"low_{f}"), F.max(f).alias(f"high_{f}"), F.sum(F.col("n") * F.col(f)).alias(f"sum_{f}"))]
    stats = {r["model"]: r for r in counted.groupBy("model").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("label")).alias("positives"), *weighted).collect()}  # a row for each model
    for name in names:
        if name not in stats:
            raise ValueError("no training rows")
        if stats[name]["positives"] in (0, stats[name]["rows"]):
            raise ValueError("training rows have one class alone")
    # a constant feature has no deviation, whatever its mean rounds to
    mean = {m: [r[f"low_{f}"] if r[f"low_{f}"] == r[f"high_{f}"] else r[f"sum_{f}"] / r["rows"] for f in FEATURES] for m, r in stats.items()}
    means = spark.createDataFrame([(m, *v) for m, v in mean.items()], "model string, " + ", ".join(f"m_{f} double" for f in FEATURES))
    squares = counted.join(F.broadcast(means), "model").groupBy("model").agg(*[F.sum(F.col("n") * F.pow(F.col(f) - F.col(f"m_{f}"), 2)).alias(f) for f in FEATURES])
    deviation = {r["model"]: [math.sqrt(r[f] / stats[r["model"]]["rows"]) or 1.0 for f in FEATURES] for r in squares.collect()}
    scales = [(m, *mean[m], *deviation[m], r["rows"] / (2 * r["positives"]), r["rows"] / (2 * (r["rows"] - r["positives"]))) for m, r in stats.items() if m in names]
    scale = spark.createDataFrame(scales, "model string, " + ", ".join(f"{k}_{f} double" for k in "md" for f in FEATURES) + ", _one double, _none double")
    z = [F.lit(1.0), *[(F.col(f) - F.col(f"m_{f}")) / F.col(f"d_{f}") for f in FEATURES]]
    size = len(z)
    weight = (F.col("n") * F.when(F.col("label") == 1, F.col("_one")).otherwise(F.col("_none"))).alias("w")
    ready = cut(counted.join(F.broadcast(scale), "model").select("model", "label", weight, *[c.alias(f"z{i}") for i, c in enumerate(z)]))
    beta = {m: np.zeros(size) for m in names}
    penalty = np.diag([0.0] + [1.0] * (size - 1))
    left = list(beta)
    for _ in range(MAX_STEPS):
        at = spark.createDataFrame([(m, *map(float, beta[m])) for m in left], "model string, " + ", ".join(f"b{i} double" for i in range(size)))
        margin = reduce(lambda a, b: a + b, [F.col(f"b{i}") * F.col(f"z{i}") for i in range(size)])
        told = ready.join(F.broadcast(at), "model").withColumn("chance", 1 / (1 + F.exp(-margin)))  # a row for each model
        step = told.select("model", *[f"z{i}" for i in range(size)], (F.col("w") * (F.col("chance") - F.col("label"))).alias("g"), (F.col("w") * F.col("chance") * (1 - F.col("chance"))).alias("h"))
        pairs = [(i, j) for i in range(size) for j in range(i + 1)]
        sums = step.groupBy("model").agg(*[F.sum(F.col("g") * F.col(f"z{i}")) for i in range(size)], *[F.sum(F.col("h") * F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs]).collect()
        for name, *own in sums:
            gradient = np.array(own[:size]) + penalty @ beta[name]
            hessian = penalty.copy()
            for (i, j), v in zip(pairs, own[size:], strict=True):
                hessian[i, j] += v
                if i != j:
                    hessian[j, i] += v
            if np.abs(gradient).max() < TOLERANCE * stats[name]["rows"]:
                left.remove(name)
            else:
                beta[name] = beta[name] - np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        if not left:
            break
    return {m: (Model(tuple(mean[m]), tuple(deviation[m]), tuple(float(b) for b in v[1:]), float(v[0])), stats[m]["rows"], stats[m]["positives"]) for m, v in beta.items()}


def fit(rows: DataFrame) -> tuple[Model, int, int]:
    """One of fits(), from rows as they are."""
    return fits(rows.groupBy("label", *FEATURES).agg(F.count("*").alias("n")).withColumn("model", F.lit("")), [""])[""]


def certificate(rows: DataFrame, model: Model) -> DataFrame:
    """One row: n, positives and gradient, the largest component of the objective's gradient at the model's coefficients, by row.

    The objective is strictly convex but for the intercept, on which both classes pull, so a gradient of nothing is that of the optimum alone: the sums judge a fit however it was found.
    """
    counts = rows.agg(F.count("*").alias("n"), F.sum("label").alias("positives"))
    z = {f: (F.col(f) - m) / d for f, m, d in zip(FEATURES, model.mean, model.deviation, strict=True)}
    weight = F.when(F.col("label") == 1, F.col("n") / (2 * F.col("positives"))).otherwise(F.col("n") / (2 * (F.col("n") - F.col("positives"))))
    pull = rows.select("label", *FEATURES).crossJoin(F.broadcast(counts)).withColumn("pull", weight * (model.score() - F.col("label")))  # counts are one row
    sums = pull.agg(F.first("n").alias("n"), F.first("positives").alias("positives"), F.sum("pull").alias("g"), *[(F.sum(F.col("pull") * c) + b).alias(f"g_{f}") for (f, c), b in zip(z.items(), model.coefficients, strict=True)])
    return sums.select("n", "positives", (F.greatest(F.abs("g"), *[F.abs(f"g_{f}") for f in FEATURES]) / F.col("n")).alias("gradient"))


def ranked(features: DataFrame, models: dict[str, Model], k: int, decimals: int | None = None) -> DataFrame:
    """query keys, task, itemid, score, rank: the first k candidates of each task by its model, then item. With ``decimals``, scores that agree so far tie."""
    keys: Sequence[str] = [c for c in ("split", "query_id", "stage") if c in features.columns]
    scores = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), (m.score() if decimals is None else F.round(m.score(), decimals)).alias("score")) for t, m in models.items()]))
    each = features.select(*keys, "itemid", scores.alias("at")).select(*keys, "itemid", "at.task", "at.score")
    return first_n(each, [*keys, "task"], [F.desc("score"), F.asc("itemid")], k)


def ranked_rows(rows: DataFrame, models: dict[str, Model], k: int, decimals: int | None = None) -> DataFrame:
    """ranked() of queries that are a row each, with items: none but the first k of a query and task become rows."""
    keys = [c for c in ("split", "query_id", "stage") if c in rows.columns]
    told = lambda m, x: m.score(feature_of(x)) if decimals is None else F.round(m.score(feature_of(x)), decimals)

    def best(m: Model) -> Column:
        return F.slice(F.sort_array(F.transform("items", lambda x: F.struct((-told(m, x)).alias("minus"), x["itemid"].alias("itemid")))), 1, k)

    tasks = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), best(m).alias("best")) for t, m in models.items()])).alias("at")
    placed = rows.select(*keys, tasks).select(*keys, "at.task", F.posexplode("at.best").alias("_pos", "_best"))
    return placed.select(*keys, "_best.itemid", "task", (-F.col("_best.minus")).alias("score"), (F.col("_pos") + 1).cast("long").alias("rank"))
