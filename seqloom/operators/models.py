"""Supervised models and their evaluation. A model has fit(df, features, label) and predict(df) -> df with prediction."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.aggregate import baseline
from seqloom.operators.matrix import principal_components
from seqloom.operators.neighbors import interpolated, nearest, vote
from seqloom.operators.table import running


@dataclass
class Baseline:
    """The mean of a real label, or the most frequent nominal."""

    nominal: bool = True
    value: object = None

    def fit(self, df: DataFrame, features: list[str], label: str) -> Baseline:
        return Baseline(self.nominal, baseline(df, label, self.nominal).first()[0])

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.value))


@dataclass
class NearestNeighbors:
    """Votes (or means of a real label) of the k nearest, on columns scaled by 1 / (2 deviations). Rows need a number column named by key."""

    k: int = 5
    key: str = "_ord"
    nominal: bool = True
    weighted: bool = True
    state: tuple = ()

    def _vector(self, df: DataFrame, scales: dict[str, float]) -> DataFrame:
        return df.withColumn("_vec", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * s for c, s in scales.items())))

    def fit(self, df: DataFrame, features: list[str], label: str) -> NearestNeighbors:
        dev = df.agg(*(F.stddev_samp(c) for c in features)).first()
        scales = {c: 1.0 / (2 * d) if d else 1.0 for c, d in zip(features, dev, strict=True)}
        return NearestNeighbors(self.k, self.key, self.nominal, self.weighted, (df, scales, label))

    def predict(self, df: DataFrame) -> DataFrame:
        train, scales, label = self.state
        found = nearest(self._vector(df, scales), self._vector(train, scales), self.k, self.key, "_vec", exclude_self=False)
        labels = train.select(F.col(self.key).cast("long").alias("neighbor"), F.col(label).alias("_y"))
        out = vote(found, labels, "_y", self.weighted) if self.nominal else interpolated(found, labels, "_y", self.weighted)
        return df.join(out, df[self.key] == out["query"], "left").drop("query")


@dataclass
class NaiveBayes:
    """Of nominal features: log counts of labels plus log((c + ess / V) / (ess + n)). Tables stay DataFrames while counting; what is kept is one number for each label,
    feature and value."""

    ess: float = 0.2
    priors: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    sizes: dict = field(default_factory=dict)

    @staticmethod
    def counts(df: DataFrame, features: list[str], label: str) -> DataFrame:
        """label, feature, value, n: the sufficient statistics, which add up over increments."""
        cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in features))
        known = df.where(F.col(label).isNotNull())
        return known.select(F.col(label).alias("label"), F.inline(cells)).where("value is not null").groupBy("label", "feature", "value").agg(F.count(F.lit(1)).alias("n"))

    def fit(self, df: DataFrame, features: list[str], label: str) -> NaiveBayes:
        priors = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
        tables: dict = {c: {} for c in features}
        for r in self.counts(df, features, label).collect():
            tables[r.feature].setdefault(r.label, {})[r.value] = r.n
        sizes = {c: len({v for t in tables[c].values() for v in t}) for c in features}
        return NaiveBayes(self.ess, priors, tables, sizes)

    def scores(self) -> dict[object, Column]:
        out = {}
        for y, n in sorted(self.priors.items(), key=lambda x: str(x[0])):
            s = F.lit(float(np.log(n)))
            for c, t in self.tables.items():
                own, size = t.get(y, {}), max(1, self.sizes[c])
                base = np.log(self.ess / size / (self.ess + n))
                cell = F.lit(float(base))
                if own:
                    m = F.create_map(*(F.lit(x) for v, k in own.items() for x in (v, float(np.log((k + self.ess / size) / (self.ess + n))))))
                    cell = F.coalesce(F.try_element_at(m, F.col(c).cast("string")), cell)
                s = s + F.when(F.col(c).isNull(), 0.0).otherwise(cell)
            out[y] = s
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        best = F.array_max(F.array(*(F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(y).alias("y")) for i, (y, s) in enumerate(self.scores().items()))))
        return df.withColumn("prediction", best["y"])


class _Spark:
    """A pyspark.ml estimator behind the same two methods; nominal labels are indexed by sorted value."""

    def __init__(self, make, nominal: bool = True):
        self.make, self.nominal = make, nominal

    def _assembled(self, df: DataFrame, features: list[str]) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return df.withColumn("_features", array_to_vector(F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features))))

    def fit(self, df: DataFrame, features: list[str], label: str):
        out = _Spark(self.make, self.nominal)
        out.features = features
        out.values = sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().collect()) if self.nominal else None
        y = F.col(label).cast("double") if not self.nominal else (F.array_position(F.array(*map(F.lit, out.values)), F.col(label)) - 1).cast("double")
        out.model = self.make(len(features), len(out.values or [])).fit(self._assembled(df, features).withColumn("_label", y).where("_label is not null"))
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self._assembled(df, self.features))
        out = out.drop("_features", "rawPrediction", "probability")
        return out.withColumn("prediction", F.get(F.array(*map(F.lit, self.values)), F.col("prediction").cast("int"))) if self.nominal else out


def _ml(module: str, name: str, **options):
    from importlib import import_module

    return getattr(import_module(f"pyspark.ml.{module}"), name)(featuresCol="_features", labelCol="_label", **options)


def decision_tree(nominal: bool = True, depth: int = 8, seed: int = 0):
    kind = "Classifier" if nominal else "Regressor"
    return _Spark(lambda d, k: _ml("classification" if nominal else "regression", f"DecisionTree{kind}", maxDepth=depth, seed=seed), nominal)


def bagged_trees(nominal: bool = True, trees: int = 20, depth: int = 8, seed: int = 0):
    """Trees of bootstrap samples that see all features."""
    kind = "Classifier" if nominal else "Regressor"
    return _Spark(lambda d, k: _ml("classification" if nominal else "regression", f"RandomForest{kind}", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed), nominal)


def neural_net(hidden: tuple[int, ...] = (8,), rounds: int = 100, seed: int = 0):
    return _Spark(lambda d, k: _ml("classification", "MultilayerPerceptronClassifier", layers=[d, *hidden, k], maxIter=rounds, seed=seed), True)


def linear_regression(ridge: float = 0.0):
    return _Spark(lambda d, k: _ml("regression", "LinearRegression", regParam=ridge), False)


@dataclass
class ComponentRegressor:
    """A label from the principal components of features and label together, all but the last."""

    state: tuple = ()

    def fit(self, df: DataFrame, features: list[str], label: str) -> ComponentRegressor:
        columns = [*features, label]
        mean, basis, _ = principal_components(df, columns, len(columns) - 1)
        inputs, out = basis[:, :-1], basis[:, -1]
        return ComponentRegressor((features, mean, np.linalg.pinv(inputs) @ out))

    def predict(self, df: DataFrame) -> DataFrame:
        features, mean, w = self.state
        return df.withColumn("prediction", F.lit(float(mean[-1])) + sum(((F.col(c) - float(m)) * float(k) for c, m, k in zip(features, mean[:-1], w, strict=True)), F.lit(0.0)))


@dataclass
class MixtureByClass:
    """Normal densities of each real feature by label, with their variances: naive Bayes of reals."""

    stats: dict = field(default_factory=dict)
    features: list = field(default_factory=list)

    def fit(self, df: DataFrame, features: list[str], label: str) -> MixtureByClass:
        rows = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(e for c in features for e in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}")))).collect()
        return MixtureByClass({r[0]: (r.n, {c: (r[f"m_{c}"], max(r[f"v_{c}"] or 0.0, 1e-9)) for c in features}) for r in rows}, features)

    def predict(self, df: DataFrame) -> DataFrame:
        scores = []
        for i, (y, (n, own)) in enumerate(sorted(self.stats.items(), key=lambda x: str(x[0]))):
            s = F.lit(float(np.log(n)))
            for c, (m, v) in own.items():
                s = s + F.coalesce(-0.5 * (F.col(c) - m) * (F.col(c) - m) / v - 0.5 * float(np.log(v)), F.lit(0.0))
            scores.append(F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(y).alias("y")))
        return df.withColumn("prediction", F.array_max(F.array(*scores))["y"])


@dataclass
class Bucket:
    """The model of several that does best in two-fold validation."""

    models: list
    nominal: bool = True
    key: str = "_ord"
    chosen: object = None

    def fit(self, df: DataFrame, features: list[str], label: str) -> Bucket:
        score = [np.mean([r.score for r in cross_validate(m, df, features, label, 2, self.nominal, self.key).collect()]) for m in self.models]
        best = int(np.argmax(score) if self.nominal else np.argmin(score))
        return Bucket(self.models, self.nominal, self.key, self.models[best].fit(df, features, label))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.chosen.predict(df)


def accuracy(df: DataFrame, label: str, nominal: bool = True) -> DataFrame:
    """score: the share of right predictions, or the mean squared error."""
    e = F.when(F.col("prediction") == F.col(label), 1.0).otherwise(0.0) if nominal else (F.col("prediction") - F.col(label)) * (F.col("prediction") - F.col(label))
    return df.agg(F.avg(e).alias("score"))


def folds(df: DataFrame, n: int, key: str = "_ord") -> DataFrame:
    return df.withColumn("fold", F.pmod(F.col(key), F.lit(n)).cast("int"))


def cross_validate(model, df: DataFrame, features: list[str], label: str, n: int = 2, nominal: bool = True, key: str = "_ord") -> DataFrame:
    """fold, score: each fold predicted by a model of the others."""
    marked, rows = folds(df, n, key), []
    for i in range(n):
        fitted = model.fit(marked.where(F.col("fold") != i), features, label)
        rows.append((i, accuracy(fitted.predict(marked.where(F.col("fold") == i)), label, nominal).first()[0]))
    return df.sparkSession.createDataFrame(rows, "fold int, score double")


def split_test(model, df: DataFrame, features: list[str], label: str, share: float = 0.5, reps: int = 5, nominal: bool = True, key: str = "_ord", seed: int = 0) -> DataFrame:
    """rep, score of held-out rows; the split is by a hash of seed, rep and key."""
    rows = []
    for i in range(reps):
        train = F.pmod(F.xxhash64(F.lit(seed + i), F.col(key)), F.lit(1_000_000)) < share * 1_000_000
        fitted = model.fit(df.where(train), features, label)
        rows.append((i, accuracy(fitted.predict(df.where(~train)), label, nominal).first()[0]))
    return df.sparkSession.createDataFrame(rows, "rep int, score double")


def precision_recall(df: DataFrame, confidence: str, positive: str, tie: str, samples: int = 100) -> DataFrame:
    """The precision curve at an even grid of recalls."""
    from seqloom.operators.aggregate import precision_curve

    curve = precision_curve(df, confidence, positive, tie)
    n = curve.agg(F.max("recalled")).first()[0] or 0
    at = F.floor(F.col("recalled") * samples / max(n, 1))
    return curve.groupBy(at.cast("int").alias("recall_percent")).agg(F.avg("precision").alias("precision"))


def label_spread(edges: DataFrame, labels: DataFrame, rounds: int = 10) -> DataFrame:
    """Semi-supervised: unlabelled nodes take the label most of their labelled neighbours have, round by round; ties to the least. labels: node, label."""
    from seqloom.session import checkpointed

    known = checkpointed(labels.select("node", "label"))
    for _ in range(rounds):
        votes = edges.join(known, edges["neighbor"] == known["node"]).groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"))
        new = votes.groupBy("query").agg(F.min(F.struct((-F.col("n")).alias("a"), F.col("label").alias("b")))["b"].alias("label")).select(F.col("query").alias("node"), "label")
        new = checkpointed(new.join(known.select("node"), "node", "left_anti"))
        if new.limit(1).count() == 0:
            break
        known = checkpointed(known.unionByName(new))
    return known


def q_step(table: DataFrame, steps: DataFrame, rate: float, discount: float) -> DataFrame:
    """One sweep of Q-learning: q (state, action, value) and steps (state, action, reward, next_state); steps with null reward are skipped."""
    best = table.groupBy(F.col("state").alias("next_state")).agg(F.greatest(F.lit(0.0), F.max("value")).alias("best"))
    target = steps.where("reward is not null").join(best, "next_state", "left").groupBy("state", "action").agg(F.avg(F.col("reward") + discount * F.coalesce("best", F.lit(0.0))).alias("target"))
    both = table.join(target, ["state", "action"], "full")
    old = F.coalesce("value", F.lit(0.0))
    return both.select("state", "action", F.when(F.col("target").isNull(), old).otherwise((1 - rate) * old + rate * F.col("target")).alias("value"))


def factorise(ratings: DataFrame, user: str, item: str, rating: str, rank: int = 8, rounds: int = 10, seed: int = 0):
    """Matrix factorisation of ratings."""
    from pyspark.ml.recommendation import ALS

    return ALS(userCol=user, itemCol=item, ratingCol=rating, rank=rank, maxIter=rounds, seed=seed, coldStartStrategy="nan").fit(ratings)


def running_mean_score(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """Accuracy so far, row by row, for incremental tests."""
    out = running(df, [F.col(c) for c in order], _seen=F.lit(1), _right=F.when(F.col("prediction") == F.col(label), 1).otherwise(0))
    return out.withColumn("score", F.col("_right") / F.col("_seen")).drop("_seen", "_right")
