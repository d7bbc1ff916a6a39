"""More supervised models, with the same two methods as those of models.py, and what works on any model: filters, chains, increments and transduction."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.graphs import min_cut
from seqloom.operators.models import NaiveBayes, accuracy


def _best(scores: list[tuple[object, Column]]) -> Column:
    """The label of the largest score; ties to the first."""
    return F.array_max(F.array(*(F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(y).alias("y")) for i, (y, s) in enumerate(scores))))["y"]


@dataclass
class NaiveInstance:
    """Instances met feature by feature: each feature's values are cut into buckets of about k instances, and the labels of the bucket a value falls into
    vote; features are taken for independent. What is kept is one number for each feature, bucket and label."""

    k: int = 40
    ess: float = 1.0
    cuts: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    priors: dict = field(default_factory=dict)

    @staticmethod
    def _bucket(c: str, cuts: list[float]) -> Column:
        """How many cuts are at most the value."""
        return F.size(F.filter(F.array(*(F.lit(float(x)) for x in cuts)), lambda x: x <= F.col(c).cast("double"))) if cuts else F.lit(0)

    def fit(self, df: DataFrame, features: list[str], label: str) -> NaiveInstance:
        known = df.where(F.col(label).isNotNull())
        priors = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
        parts = max(1, min(256, sum(priors.values()) // self.k))
        shares = [i / parts for i in range(1, parts)]
        found = known.agg(*(F.percentile_approx(F.col(c).cast("double"), shares or [0.5], 10_000) for c in features)).first()
        cuts = {c: sorted(set(q or [])) if shares else [] for c, q in zip(features, found, strict=True)}
        cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), self._bucket(c, cuts[c])).alias("bucket")) for c in features))
        tables: dict = {c: {} for c in features}
        for r in known.select(F.col(label).alias("y"), F.inline(cells)).where("bucket is not null").groupBy("y", "feature", "bucket").count().collect():
            tables[r["feature"]].setdefault(r["y"], {})[r["bucket"]] = r["count"]
        return NaiveInstance(self.k, self.ess, cuts, tables, priors)

    def predict(self, df: DataFrame) -> DataFrame:
        scores = []
        for y, n in sorted(self.priors.items(), key=lambda x: str(x[0])):
            s = F.lit(float(np.log(n)))
            for c, cuts in self.cuts.items():
                own = self.tables[c].get(y, {})
                logs = [float(np.log((own.get(b, 0) + self.ess / (len(cuts) + 1)) / (n + self.ess))) for b in range(len(cuts) + 1)]
                s = s + F.when(F.col(c).isNull(), 0.0).otherwise(F.get(F.array(*map(F.lit, logs)), self._bucket(c, cuts)))
            scores.append((y, s))
        return df.withColumn("prediction", _best(scores))


@dataclass
class MeanMarginsTree:
    """Each node is cut halfway between the mean of its most frequent label and that of the rest, across the line between them. All nodes of a
    level are fitted by one aggregation."""

    depth: int = 6
    least: int = 20
    nodes: dict = field(default_factory=dict)
    features: list = field(default_factory=list)

    def _node(self, number: int = 1) -> Column:
        """The number of the node a row ends in, of those there are so far."""
        kind, *rest = self.nodes.get(number, ("open",))
        if kind != "cut":
            return F.lit(number)
        side = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(x) for c, x in zip(self.features, rest[0], strict=True)), F.lit(0.0)) > float(rest[1])
        return F.when(side, self._node(2 * number + 1)).otherwise(self._node(2 * number))

    def fit(self, df: DataFrame, features: list[str], label: str) -> MeanMarginsTree:
        known, tree = df.where(F.col(label).isNotNull()), MeanMarginsTree(self.depth, self.least, {}, features)
        for level in range(self.depth + 1):
            rows = known.withColumn("_node", tree._node()).groupBy("_node", F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"m{i}") for i, c in enumerate(features))).collect()
            by_node: dict = {}
            for r in rows:
                by_node.setdefault(r["_node"], []).append((r["n"], r["_y"], np.array([r[f"m{i}"] for i in range(len(features))])))
            for number, own in by_node.items():
                if number in tree.nodes:
                    continue
                own.sort(key=lambda x: (-x[0], str(x[1])))
                rest = sum(n for n, _, _ in own[1:])
                other = sum(n * m for n, _, m in own[1:]) / rest if rest else own[0][2]
                w = other - own[0][2]
                if level == self.depth or own[0][0] + rest < self.least or not np.abs(w).max() > 1e-12:
                    tree.nodes[number] = ("leaf", own[0][1])
                else:
                    tree.nodes[number] = ("cut", w, float(w @ (other + own[0][2]) / 2))
        return tree

    def predict(self, df: DataFrame) -> DataFrame:
        leaves = {n: x[1] for n, x in self.nodes.items() if x[0] == "leaf"}
        majority = next(iter(leaves.values()), None)
        names = F.create_map(*(F.lit(v) for n, y in leaves.items() for v in (n, y)))
        return df.withColumn("prediction", F.coalesce(F.try_element_at(names, self._node()), F.lit(majority)))

    def text(self) -> str:
        """The tree, a node a line."""
        lines = []
        for n, (kind, *rest) in sorted(self.nodes.items(), key=lambda x: bin(x[0])[2:]):
            pad = "  " * (n.bit_length() - 1)
            lines.append(pad + (f"-> {rest[0]}" if kind == "leaf" else " + ".join(f"{w:.4g} {c}" for w, c in zip(rest[0], self.features, strict=True)) + f" > {rest[1]:.4g}?"))
        return "\n".join(lines)


@dataclass
class InstanceTable:
    """Exact instances: the most frequent label of each combination of feature values, and of all where it was never seen. The table is counts, which add up
    over increments."""

    counts: DataFrame | None = None
    features: list = field(default_factory=list)
    label: str = ""

    def fit(self, df: DataFrame, features: list[str], label: str) -> InstanceTable:
        return InstanceTable(df.where(F.col(label).isNotNull()).groupBy(*features, F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("_n")), features, label)

    def increment(self, df: DataFrame) -> InstanceTable:
        more = self.fit(df, self.features, self.label).counts
        return InstanceTable(self.counts.unionByName(more).groupBy(*self.features, "_y").agg(F.sum("_n").alias("_n")), self.features, self.label)

    def predict(self, df: DataFrame) -> DataFrame:
        rank = F.struct((-F.col("_n")).alias("n"), F.col("_y").alias("y"))
        best = self.counts.groupBy(*(F.col(c).alias(f"_k_{c}") for c in self.features)).agg(F.min(rank)["y"].alias("prediction"))
        common = self.counts.groupBy("_y").agg(F.sum("_n").alias("_n")).agg(F.min(rank)["y"]).first()[0]
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in self.features]
        joined = df.join(best, same, "left").drop(*(f"_k_{c}" for c in self.features))
        return joined.withColumn("prediction", F.coalesce("prediction", F.lit(common)))


class KernelMachine:
    """A Gaussian kernel by random features of its spectrum, under a linear classifier; scales to any number of rows."""

    def __init__(self, variance: float = 1.0, places: int = 100, seed: int = 0):
        self.variance, self.places, self.seed = variance, places, seed

    def _mapped(self, df: DataFrame) -> DataFrame:
        x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features]
        waves = [F.cos(sum((a * float(w) for a, w in zip(x, row, strict=True)), F.lit(float(b)))) for row, b in zip(self.w, self.b, strict=True)]
        return df.withColumns({f"_k{i}": f for i, f in enumerate(waves)})

    def fit(self, df: DataFrame, features: list[str], label: str) -> KernelMachine:
        from seqloom.operators.models import _ml, _Spark

        out, rng = KernelMachine(self.variance, self.places, self.seed), np.random.default_rng(self.seed)
        out.features, out.w, out.b = features, rng.normal(size=(self.places, len(features))) / self.variance**0.5, rng.uniform(0, 2 * np.pi, self.places)
        names = [f"_k{i}" for i in range(self.places)]
        out.model = _Spark(lambda d, k: _ml("classification", "LogisticRegression", regParam=1e-4, maxIter=50)).fit(out._mapped(df), names, label)
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.predict(self._mapped(df)).drop(*(f"_k{i}" for i in range(self.places)))


def increment_naive_bayes(model: NaiveBayes, df: DataFrame, features: list[str], label: str) -> NaiveBayes:
    """The model of the rows it was fitted on and df together; counts add up."""
    new = NaiveBayes(model.ess).fit(df, features, label)
    add = lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in {**a, **b}}
    tables = {c: {y: add(model.tables[c].get(y, {}), new.tables[c].get(y, {})) for y in {**model.tables[c], **new.tables[c]}} for c in features}
    return NaiveBayes(model.ess, add(model.priors, new.priors), tables, {c: len({v for t in tables[c].values() for v in t}) for c in features})


@dataclass
class Filtered:
    """A model behind transforms: make is called with the training rows and gives an object with apply(); the features may change."""

    makes: list
    model: object
    features: list | None = None
    fitted: tuple = ()

    def fit(self, df: DataFrame, features: list[str], label: str) -> Filtered:
        chain = Chain(self.makes).fit(df)
        names = self.features or features
        return Filtered(self.makes, self.model, self.features, (chain, self.model.fit(chain.apply(df), names, label)))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.fitted[1].predict(self.fitted[0].apply(df))


@dataclass
class Chain:
    """Transforms one after the other, each fitted on what the ones before make of the rows."""

    makes: list
    steps: tuple = ()

    def fit(self, df: DataFrame) -> Chain:
        steps = []
        for make in self.makes:
            steps.append(make(df))
            df = steps[-1].apply(df)
        return Chain(self.makes, tuple(steps))

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.apply(df)
        return df

    def undo(self, df: DataFrame) -> DataFrame:
        for step in reversed(self.steps):
            df = step.undo(df)
        return df


@dataclass(frozen=True)
class Rotation:
    """Columns turned onto all their principal axes, about the mean; no dimension is lost."""

    columns: tuple[str, ...]
    mean: np.ndarray
    basis: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> Rotation:
        from seqloom.operators.matrix import principal_components

        mean, basis, _ = principal_components(df, columns, len(columns))
        return cls(tuple(columns), mean, basis)

    def apply(self, df: DataFrame) -> DataFrame:
        from seqloom.operators.matrix import projected

        out = projected(df, list(self.columns), self.mean, self.basis, "_pc")
        return out.withColumns({c: F.col(f"_pc{i}") for i, c in enumerate(self.columns)}).drop(*(f"_pc{i}" for i in range(len(self.columns))))

    def undo(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.lit(float(m)) + sum((F.col(x) * float(self.basis[i, j]) for i, x in enumerate(self.columns)), F.lit(0.0)) for j, (c, m) in enumerate(zip(self.columns, self.mean, strict=True))})


def predict_one(spark, model, row: dict):
    """The prediction for one row given as a dict."""
    return model.predict(spark.createDataFrame([row])).first()["prediction"]


def transduce(model, labelled: DataFrame, unlabelled: DataFrame, features: list[str], label: str) -> DataFrame:
    """unlabelled with prediction, by a model of the labelled rows."""
    return model.fit(labelled, features, label).predict(unlabelled)


def transductive_accuracy(model, labelled: DataFrame, unlabelled: DataFrame, features: list[str], label: str) -> DataFrame:
    """score of the labels predicted for rows whose labels are known but not shown."""
    return accuracy(transduce(model, labelled, unlabelled, features, label), label)


def heuristic_score(model, df: DataFrame, features: list[str], label: str, key: str = "_ord") -> float:
    """Accuracy on the other half of models of each half: (a + b) / 2."""
    from seqloom.operators.models import cross_validate

    return float(np.mean([r.score for r in cross_validate(model, df, features, label, 2, True, key).collect()]))


def agglomerative_labels(points: np.ndarray, labels: list) -> list:
    """For a set that fits one machine: the closest clusters merge unless both have labels that differ; null labels take their cluster's."""
    group, own = list(range(len(points))), list(labels)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    order = sorted((d[i, j], i, j) for i in range(len(points)) for j in range(i))
    for _, i, j in order:
        a, b = group[i], group[j]
        if a != b and (own[a] is None or own[b] is None or own[a] == own[b]):
            own[a] = own[a] if own[a] is not None else own[b]
            group = [a if g == b else g for g in group]
    return [own[g] for g in group]


def graph_cut_labels(points: np.ndarray, labels: list, neighbors: int = 5) -> list:
    """For a set that fits one machine: label by label, the cut of least weight in the graph of neighbours that parts its rows from those of other labels."""
    n, out = len(points), list(labels)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    edges = {(min(i, int(j)), max(i, int(j))): 1 / max(d[i, j], 1e-9) for i in range(n) for j in np.argsort(d[i], kind="stable")[1 : neighbors + 1]}
    top = 1e6 * (1 + sum(edges.values()))
    for y in sorted({x for x in labels if x is not None}, key=str):
        ties = [(n, i, top) for i in range(n) if labels[i] == y] + [(i, n + 1, top) for i in range(n) if labels[i] is not None and labels[i] != y]
        _, side = min_cut(n + 2, [(a, b, w) for (a, b), w in edges.items()] + ties, n, n + 1)
        for i in side:
            if i < n and out[i] is None:
                out[i] = y
    return out
