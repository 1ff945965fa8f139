"""Folds, standardisation, linear models from sufficient statistics, and metrics.

Ridge and OLS never collect rows: each fold reduces to X'X and X'y sums, of a size
set by the number of features alone, and these small systems are solved by the
executors, a row each. Row numbers are counted by ranges (see ``ranges``), so a key's
history is never in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators import ranges


def fold_table(n: int, train: int, test: int, step: int) -> list[tuple[int, int, int, int]]:
    """(fold, first training row, first test row, end) by row number from 0."""
    return [(k, a, a + train, a + train + test) for k, a in enumerate(range(0, n - train - test + 1, step))]


def walk_forward(df: DataFrame, key: str, order: list[str], train: int, test: int, step: int, width: int = ranges.WIDTH) -> DataFrame:
    """Every row once for each fold it is in, with ``fold`` and ``is_test``; ``width``: see ``ranges``."""
    df = ranges.numbered(df, [key], order, "_i", total="_n", width=width).withColumn("_i", F.col("_i") - 1)
    low = F.greatest(F.lit(0), F.ceil((F.col("_i") - (train + test) + 1) / step))
    high = F.least(F.floor(F.col("_i") / step), F.floor((F.col("_n") - train - test) / step))
    df = df.where((F.col("_n") >= train + test) & (low <= high)).withColumn("fold", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    return df.withColumn("is_test", F.col("_i") >= F.col("fold") * step + train).drop("_i", "_n")


def temporal_split(df: DataFrame, key: str, order: list[str], share: float, width: int = ranges.WIDTH) -> DataFrame:
    """``is_test`` marks each key's rows after its first ``share``."""
    df = ranges.numbered(df, [key], order, "_i", total="_n", width=width)
    return df.withColumn("is_test", F.col("_i") > F.floor(F.col("_n") * share)).drop("_i", "_n")


def standardised(df: DataFrame, groups: list[str], features: list[str], clip: float = 5.0) -> DataFrame:
    """Features by the training rows' mean and population deviation (0 counts as 1); test rows are clipped."""
    train = ~F.col("is_test")
    moments = [m for f in features for m in (F.avg(F.when(train, F.col(f))).alias(f"_m_{f}"), F.stddev_pop(F.when(train, F.col(f))).alias(f"_s_{f}"))]
    df = df.join(df.groupBy(*groups).agg(*moments), groups)
    scaled = {}
    for f in features:
        sd = F.when(F.coalesce(F.col(f"_s_{f}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"_s_{f}"))
        z = (F.col(f) - F.col(f"_m_{f}")) / sd
        scaled[f] = F.when(F.col("is_test"), F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))).otherwise(z)
    df = df.withColumns(scaled)
    return df.drop(*[f"_{k}_{f}" for f in features for k in "ms"])


#: Up to so many columns their products are summed by expressions; beyond it plans of their square would be too large.
_EXPRESSIONS = 8
_HELD_GROUPS = 500


def _moments(df: DataFrame, groups: list[str], features: list[str], target: str) -> DataFrame:
    """Per group _xx (products of a constant and the features, flattened), _xy, _yy and _rows."""
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(target).cast("double")
    if len(cols) <= _EXPRESSIONS:
        xx, xy = F.array(*[F.sum(a * b) for a in cols for b in cols]), F.array(*[F.sum(a * y) for a in cols])
        return df.groupBy(*groups).agg(xx.alias("_xx"), xy.alias("_xy"), F.sum(y * y).alias("_yy"), F.count("*").alias("_rows"))
    kinds = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in groups)
    schema = kinds + ", _xx array<double>, _xy array<double>, _yy double, _rows long"

    def row(key: tuple, m: np.ndarray, n: int) -> tuple:  # m: products of (1, features, target)
        return (*key, m[:-1, :-1].ravel().tolist(), m[:-1, -1].tolist(), float(m[-1, -1]), n)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        names = [*groups, "_xx", "_xy", "_yy", "_rows"]
        for d in batches:
            for key, g in d.groupby(groups, sort=False, dropna=False):
                z = np.column_stack([np.ones(len(g)), g[[*features, target]].to_numpy(float)])
                m = held.setdefault(key, [0.0, 0])
                m[0], m[1] = m[0] + z.T @ z, m[1] + len(g)
            if len(held) > _HELD_GROUPS:
                yield pd.DataFrame([row(key, *m) for key, m in held.items()], columns=names)
                held = {}
        yield pd.DataFrame([row(key, *m) for key, m in held.items()], columns=names)

    def total(g: pd.DataFrame) -> pd.DataFrame:  # a row for each partition that held some of the group
        out = g[groups].iloc[:1].reset_index(drop=True)
        return out.assign(_xx=[np.sum(g["_xx"].tolist(), axis=0).tolist()], _xy=[np.sum(g["_xy"].tolist(), axis=0).tolist()], _yy=g["_yy"].sum(), _rows=g["_rows"].sum())

    used = df.select(*groups, *[F.col(f).cast("double").alias(f) for f in features], y.alias(target))
    return used.mapInPandas(partial, schema).groupBy(*groups).applyInPandas(total, schema)


def ridge(df: DataFrame, groups: list[str], features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """Coefficients per group: (groups, intercept, coefficients, t_values) fitted on rows where not is_test.

    The intercept is not penalised. One pass sums the products, combined before they are
    shuffled; each group's system is solved where its sums are. t_values are those of ordinary least squares, the
    intercept's first; null where ``alpha`` is not 0 or no degree of freedom is left.
    """
    k = len(features) + 1
    sums = _moments(df.where("not is_test"), groups, features, target)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        penalty = np.eye(k) * alpha
        penalty[0, 0] = 0
        for d in batches:
            found = []
            for xx, xy, yy, n in zip(d["_xx"], d["_xy"], d["_yy"], d["_rows"]):
                A, b = np.array(xx, dtype=float).reshape(k, k), np.array(xy, dtype=float)
                w = np.linalg.lstsq(A + penalty, b, rcond=None)[0]
                t = None
                if alpha == 0 and n > k:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        t = (w / np.sqrt(np.maximum(yy - w @ b, 0) / (n - k) * np.diag(np.linalg.pinv(A)))).tolist()
                found.append((float(w[0]), w[1:].tolist(), t))
            yield d[groups].assign(intercept=[f[0] for f in found], coefficients=[f[1] for f in found], t_values=[f[2] for f in found])

    kinds = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in groups)
    return sums.mapInPandas(solve, kinds + ", intercept double, coefficients array<double>, t_values array<double>")


def predicted(df: DataFrame, models: DataFrame, groups: list[str], features: list[str]) -> DataFrame:
    """``df`` with the prediction of its group's model; Spark broadcasts the models where their size allows."""
    score = sum((F.col("coefficients")[i] * F.col(f) for i, f in enumerate(features)), F.col("intercept"))
    return df.join(models.select(*groups, "intercept", "coefficients"), groups).withColumn("predicted", score).drop("intercept", "coefficients")


def regression_metrics(y: Column, p: Column, confident: Column | None = None) -> dict[str, Column]:
    """R2, share of right signs, the same among ``confident`` rows, and rows."""
    right = (F.signum(y) == F.signum(p)).cast("double")
    sse, sst = F.sum((y - p) * (y - p)), F.sum(y * y) - F.sum(y) * F.avg(y)
    return {"r2": F.when(sst > 0, 1 - sse / sst), "direction": F.avg(right), "confident_direction": F.avg(F.when(confident, right)) if confident is not None else F.avg(right), "n": F.count("*")}


def auc(df: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """Rank-sum AUC with average ranks for ties; 0.5 where one class is missing."""
    w = Window.partitionBy(*groups).orderBy(score)
    ties = Window.partitionBy(*groups, score)
    df = df.withColumn("_r", F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0)
    one, zero = F.sum((F.col(label) == 1).cast("long")), F.sum((F.col(label) == 0).cast("long"))
    g = df.groupBy(*groups).agg(one.alias("_p"), zero.alias("_n"), F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("_s"))
    value = (F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2.0) / (F.col("_p") * F.col("_n"))
    return g.select(*groups, F.when((F.col("_p") == 0) | (F.col("_n") == 0), 0.5).otherwise(value).alias("auc"))


def precision_at(df: DataFrame, groups: list[str], score: str, label: str, order: list[str], share: float) -> DataFrame:
    by = Window.partitionBy(*groups)
    df = df.withColumn("_i", F.row_number().over(by.orderBy(F.col(score).desc(), *order))).withColumn("_n", F.count("*").over(by))
    top = F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    return df.groupBy(*groups).agg(F.avg(F.when(top, F.col(label).cast("double"))).alias("precision"), F.try_divide(F.sum(F.when(top, F.col(label))), F.sum(label)).alias("capture"))


def average_precision(df: DataFrame, groups: list[str], score: str, label: str, order: list[str]) -> DataFrame:
    """Mean precision at the rank of each positive."""
    by = Window.partitionBy(*groups).orderBy(F.col(score).desc(), *order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_p", F.sum(label).over(by) / F.count("*").over(by))
    return df.groupBy(*groups).agg(F.avg(F.when(F.col(label) == 1, F.col("_p"))).alias("average_precision"))


def gated_value(df: DataFrame, groups: list[str], score: str, fee: str, loss: str, order: list[str], share: float) -> DataFrame:
    """Fees less losses of all rows, without the ``share`` of highest score, and, as a bound, without that of highest loss."""
    by = Window.partitionBy(*groups)
    place = lambda c: F.row_number().over(by.orderBy(F.col(c).desc(), *order))
    df = df.withColumns({"_i": place(score), "_j": place(loss), "_k": F.floor(F.count("*").over(by) * share)})
    net = F.col(fee) - F.col(loss)
    kept = lambda at: F.sum(F.when(F.col(at) > F.col("_k"), net).otherwise(0.0))
    return df.groupBy(*groups).agg(F.sum(net).alias("passive"), kept("_i").alias("gated"), kept("_j").alias("oracle"))


def logistic(df: DataFrame, features: list[str], label: str, c: float = 1.0, balanced: bool = False) -> DataFrame:
    """L2 logistic regression; ``balanced`` weighs classes inversely to their frequency."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    train = rows.where("not is_test")
    n = {int(r[label]): r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two classes
    total = sum(n.values())
    weight = F.lit(1.0)
    if balanced:
        weight = F.when(F.col(label) == 1, total / (2.0 * n.get(1, 1))).otherwise(total / (2.0 * n.get(0, 1)))
    train = train.withColumn("_w", weight)
    model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=1.0 / (c * total), standardization=False, maxIter=200, tol=1e-10).fit(train)
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("probability", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "prediction")


#: (leaf, feature, highest code that stays) of each split; the rows that do not stay make the next leaf.
_MODEL = "splits array<array<array<int>>>, values array<array<double>>, gains array<double>, base double"


def _tree(codes: list[np.ndarray], n: np.ndarray, r: np.ndarray, leaves: int, least: int, l2: float) -> tuple[list, list[np.ndarray], list[float]]:
    """Splits, rows of each leaf and gains of a tree grown leaf by leaf, best gain first, on ``n`` rows a cell with residuals of sum ``r``."""
    sizes = [int(c.max()) + 1 for c in codes]

    def sums(at: np.ndarray) -> list[np.ndarray]:
        return [np.stack([np.bincount(c[at], v[at], size) for v in (n, r)]) for c, size in zip(codes, sizes)]

    def best(h: list[np.ndarray]) -> tuple[float, int, int]:
        found = (0.0, 0, 0)
        for f, x in enumerate(h):
            (a, g), (a_all, g_all) = x.cumsum(axis=1)[:, :-1], x.sum(axis=1)
            b = a_all - a
            gain = np.where((a >= least) & (b >= least), g**2 / (a + l2) + (g_all - g) ** 2 / (b + l2) - g_all**2 / (a_all + l2), 0.0)
            if gain.size and gain.max() > found[0]:
                found = (float(gain.max()), f, int(gain.argmax()))
        return found

    held, made = [np.arange(len(n))], [sums(np.arange(len(n)))]
    wanted, splits, gains = [best(made[0])], [], [0.0] * len(codes)
    while len(held) < leaves:
        k = max(range(len(held)), key=lambda i: wanted[i][0])
        gain, f, t = wanted[k]
        if gain <= 0:
            break
        stays = codes[f][held[k]] <= t
        sides = [held[k][stays], held[k][~stays]]
        few = int(len(sides[1]) < len(sides[0]))
        h = sums(sides[few])  # the larger side is what is left
        pair = [h, h]
        pair[1 - few] = [x - y for x, y in zip(made[k], h)]
        held[k], made[k], wanted[k] = sides[0], pair[0], best(pair[0])
        held.append(sides[1])
        made.append(pair[1])
        wanted.append(best(pair[1]))
        splits.append([k, f, t])
        gains[f] += gain
    return splits, held, gains


def _rounds(codes: list[np.ndarray], n: np.ndarray, y: np.ndarray, held_out: tuple[np.ndarray, ...], rounds: int, patience: int, rate: float, leaves: int, least: int, l2: float) -> tuple:
    """``_MODEL``: the trees up to the round of least error on ``held_out`` (rows, sum, sum of squares a cell)."""
    m, sy, syy = held_out
    base = float(y.sum() / n.sum())
    at, splits, values, gains = np.full(len(n), base), [], [], []
    least_error, kept = np.inf, 0
    for k in range(rounds):
        s, held, g = _tree(codes, n, y - n * at, leaves, least, l2)
        if not s:
            break
        v = [float(rate * (y[i] - n[i] * at[i]).sum() / (n[i].sum() + l2)) for i in held]
        for i, x in zip(held, v):
            at[i] += x
        splits.append(s)
        values.append(v)
        gains.append(g)
        error = float((syy - 2 * at * sy + m * at**2).sum()) if m.any() else -k  # without held-out rows all rounds count
        if error < least_error:
            least_error, kept = error, k + 1
        elif k + 1 - kept >= patience:
            break
    return splits[:kept], values[:kept], np.sum(gains[:kept] or [[0.0] * len(codes)], axis=0).tolist(), base


def boosted(df: DataFrame, features: list[str], target: str, order: list[str], tail: float = 0.15, *, rounds: int = 500, patience: int = 30, rate: float = 0.05, leaves: int = 31, least: int = 200, l2: float = 1.0, bins: int = 255, width: int = ranges.WIDTH) -> tuple[DataFrame, list[float]]:
    """Gradient-boosted regression: ``df`` with ``predicted``, and each feature's gain.

    It stops once ``patience`` rounds have not lowered the error on the last ``tail`` of the training rows in ``order``, and
    keeps the rounds up to the best. Trees only see the bin of a value, so rows with the same bins are alike: they are
    counted and summed by Spark, once, and all rounds run in one task over these cells, at most ``bins`` to the power of
    the features and usually far fewer. Nulls and NaN are the highest bin; rows without a target are not trained on.
    ``width``: see ``ranges``.
    """
    from pyspark.ml.feature import Bucketizer

    train = ~F.col("is_test") & F.col(target).isNotNull()
    placed = ranges.numbered(df.where(train).select(*order), [], order, "_i", total="_n", width=width)
    cut = placed.where(F.col("_i") == F.greatest(F.lit(1), F.floor(F.col("_n") * (1 - tail)))).select(*order).first()  # one row
    if cut is None:
        return df.withColumn("predicted", F.lit(None).cast("double")), [0.0] * len(features)
    late = F.struct(*order) > F.struct(*[F.lit(cut[c]).cast(df.schema[c].dataType).alias(c) for c in order])
    # edges are a row for each feature, of a length set by ``bins``
    edges = df.where(train & ~late).select(*[F.col(f).cast("double").alias(f) for f in features]).approxQuantile(features, [k / bins for k in range(1, bins)], 0.25 / bins)
    edges = [[-np.inf, *(sorted({e for e in x if np.isfinite(e)}) or [0.0]), np.inf] for x in edges]
    names = [f"_bin{i}" for i in range(len(features))]
    binned = Bucketizer(splitsArray=edges, inputCols=features, outputCols=names, handleInvalid="keep").transform(df)
    binned = binned.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(len(x) - 1)) for c, x in zip(names, edges)})  # nulls, as NaN
    y = F.col(target).cast("double")
    part = lambda of, x: F.coalesce(F.sum(F.when(of, x)), F.lit(0.0))
    cells = binned.where(train).groupBy(*names).agg(*[part(of, x).alias(c) for c, of, x in (("_n", ~late, F.lit(1.0)), ("_y", ~late, y), ("_m", late, F.lit(1.0)), ("_my", late, y), ("_myy", late, y * y))])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(batches)).sort_values(names)
        columns = [d[c].to_numpy(float) for c in ("_n", "_y", "_m", "_my", "_myy")]
        found = _rounds([d[c].to_numpy(np.int64) for c in names], *columns[:2], tuple(columns[2:]), rounds, patience, rate, leaves, least, l2)
        yield pd.DataFrame([found], columns=["splits", "values", "gains", "base"])

    splits, values, gains, base = cells.repartition(1).mapInPandas(fit, _MODEL).first()  # one row

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            codes, out = [d[c].to_numpy() for c in names], np.full(len(d), base)
            for tree, v in zip(splits, values):
                leaf = np.zeros(len(d), dtype=np.int64)
                for k, (at, f, t) in enumerate(tree):
                    leaf[(leaf == at) & (codes[f] > t)] = k + 1
                out += np.array(v)[leaf]
            yield d.assign(predicted=out)

    scored = binned.select(*names).distinct().mapInPandas(score, ", ".join(f"{c} int" for c in names) + ", predicted double")
    return binned.join(scored, names).drop(*names), gains
