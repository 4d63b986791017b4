"""Adaptive parameters: a fold over scores in order, as batch expression and as plain function for streams."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import values as V


@dataclass
class Params:
    threshold: float = V.THRESHOLD_START
    rate: float = V.RATE_START
    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(V.STRATEGIES, 1.0))
    history: list[float] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def reset() -> Params:
        """The parameters at first start."""
        return Params()

    @staticmethod
    def from_json(text: str) -> Params:
        return Params(**json.loads(text))


def ewma(history: list[float]) -> float:
    last = history[-V.EWMA_WINDOW :]
    if not last:
        return 0.0
    v = last[0]
    for s in last[1:]:
        v = V.EWMA_ALPHA * s + (1 - V.EWMA_ALPHA) * v
    return v


def variance(history: list[float]) -> float:
    last = history[-V.VARIANCE_WINDOW :]
    if len(last) < 2:
        return 0.0
    m = sum(last) / len(last)
    return min(1.0, sum((x - m) ** 2 for x in last) / len(last))


def update(p: Params, score: float, strategy: str | None = None) -> Params:
    """One score: history, the strategy's weight at the old rate, threshold, then rate."""
    history = [*p.history, score][-V.HISTORY :]
    weights = dict(p.weights)
    if strategy is not None:
        step = max(-V.WEIGHT_STEP, min(V.WEIGHT_STEP, (score - 0.5) * p.rate))
        weights[strategy] = max(V.WEIGHT_MIN, min(V.WEIGHT_MAX, weights.get(strategy, 1.0) + step))
        mean = sum(weights.values()) / len(weights)
        weights = {k: w / mean for k, w in weights.items()}
    e, v = ewma(history), variance(history)
    threshold = max(V.THRESHOLD_MIN, min(V.THRESHOLD_MAX, p.threshold + (-V.THRESHOLD_STEP if e > 0.7 else V.THRESHOLD_STEP if e < 0.3 else 0.0)))
    rate = max(V.RATE_MIN, min(V.RATE_MAX, p.rate + (V.RATE_STEP if v < 0.1 else -V.RATE_STEP if v > 0.3 else 0.0)))
    return Params(threshold, rate, weights, history)


def ewma_expr(scores: Column) -> Column:
    """EWMA of the last EWMA_WINDOW entries of an array; 0 for an empty one."""
    last = F.slice(scores, F.greatest(F.size(scores) - (V.EWMA_WINDOW - 1), F.lit(1)), V.EWMA_WINDOW)
    # the first entry seeds the fold and is folded in once more without effect
    return F.when(F.size(scores) == 0, 0.0).otherwise(F.aggregate(last, F.element_at(F.concat(last, F.array(F.lit(0.0))), 1), lambda a, x: a * (1 - V.EWMA_ALPHA) + x * V.EWMA_ALPHA))


def variance_expr(scores: Column) -> Column:
    last = F.slice(scores, F.greatest(F.size(scores) - (V.VARIANCE_WINDOW - 1), F.lit(1)), V.VARIANCE_WINDOW)
    n = F.size(last)
    mean = F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n < 2, 0.0).otherwise(F.least(F.lit(1.0), F.aggregate(last, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n))


def recent_statistics(log: DataFrame, key: str, order: list[str], score: str) -> DataFrame:
    """(key, n, ewma, variance) over the last scores of each key.

    A window keeps the last VARIANCE_WINDOW rows of each key before they are gathered, so a key with a third of the log
    hands on thirty rows.
    """
    from docloom.operators.recommend import trailing

    n = log.groupBy(key).agg(F.count(score).alias("n"))
    last = trailing(log.where(F.col(score).isNotNull()).select(key, *order, score), [key], order, max(V.VARIANCE_WINDOW, V.EWMA_WINDOW))
    arr = last.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, score))), lambda x: x[score]).alias("s"))
    return n.join(arr, key, "left").select(key, "n", ewma_expr(F.coalesce("s", F.array().cast("array<double>"))).alias("ewma"), variance_expr(F.coalesce("s", F.array().cast("array<double>"))).alias("variance"))


def fold(log: DataFrame, key: str, order: list[str], score: str, strategy: str | None = None) -> DataFrame:
    """(key, n, threshold, rate, weights) after all scores of each key, in order.

    The fold is sequential by its nature, so a key is one task; rows stream through it in Arrow batches, sorted by Spark,
    and only the parameters and the last HISTORY scores are held.
    """
    import pandas as pd

    cols = [key, *order, score, *([strategy] if strategy else [])]
    src = log.select(*cols).where(F.col(key).isNotNull() & F.col(score).isNotNull())

    def run(batches):
        state: Params | None = None
        current, n, out = None, 0, []

        def row():
            return (current, n, state.threshold, state.rate, state.weights)

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                k = r[0]
                if state is None or k != current:
                    if state is not None:
                        out.append(row())
                    state, current, n = Params(), k, 0
                state = update(state, float(r[len(order) + 1]), r[len(order) + 2] if strategy else None)
                n += 1
            if out:
                yield pd.DataFrame(out, columns=["key", "n", "threshold", "rate", "weights"])
                out = []
        if state is not None:
            yield pd.DataFrame([row()], columns=["key", "n", "threshold", "rate", "weights"])

    kind = src.schema[key].dataType.simpleString()
    return src.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"key {kind}, n long, threshold double, rate double, weights map<string,double>").withColumnRenamed("key", key)


def normalised_weights(weights: Column) -> Column:
    vals = F.map_values(weights)
    mean = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.size(vals)
    return F.transform_values(weights, lambda _, v: v / mean)


def strategy_ranking(weights: Column) -> Column:
    """Strategies by weight, descending; equals by name."""
    return F.transform(F.array_sort(F.transform(F.map_entries(weights), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), lambda e: e["k"])
