"""Supervised labelling of events with Spark ML, and its metrics."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import transforms
from ..functions.quantiles import running
from ..functions.transforms import Scaler, number
from . import populations as P
from . import sampling
from .sampling import key


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k * count) for each class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))
    return counts.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts of each pair, and their share of the actual class."""
    n = df.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(actual)))


def _cells(df: DataFrame, actual: str, predicted: str) -> dict[tuple, int]:
    return {(r[0], r[1]): r.n for r in df.groupBy(actual, predicted).agg(F.count("*").alias("n")).collect()}


def metrics(df: DataFrame, actual: str, predicted: str, names: tuple[str, ...] = ("balanced_accuracy", "f1_weighted")) -> dict[str, float]:
    """Scores from one grouped count: accuracy, balanced_accuracy, and precision, recall, f1 with _micro, _macro or _weighted."""
    cells = _cells(df, actual, predicted)
    n = sum(cells.values())
    classes = sorted({c for k in cells for c in k if c is not None}, key=str)
    hit = {c: cells.get((c, c), 0) for c in classes}
    true = {c: sum(v for (a, _), v in cells.items() if a == c) for c in classes}
    said = {c: sum(v for (_, p), v in cells.items() if p == c) for c in classes}
    ratio = lambda a, b: a / b if b else 0.0
    each = {c: {"precision": ratio(hit[c], said[c]), "recall": ratio(hit[c], true[c]), "f1": ratio(2 * hit[c], said[c] + true[c])} for c in classes}

    def one(name: str) -> float:
        if name == "accuracy":
            return sum(hit.values()) / n
        if name == "balanced_accuracy":
            seen = [c for c in classes if true[c]]
            return sum(each[c]["recall"] for c in seen) / len(seen)
        kind, _, how = name.partition("_")
        if kind not in ("precision", "recall", "f1"):
            raise ValueError(f"unknown metric {name!r}")
        if how == "micro":
            return sum(hit.values()) / n
        if how == "weighted":
            return sum(each[c][kind] * true[c] for c in classes) / n
        return sum(e[kind] for e in each.values()) / len(classes)

    return {name: one(name) for name in names}


def roc_auc(df: DataFrame, actual: str, score: str) -> float:
    """Area under the curve of a 0/1 label, from average ranks of distinct scores."""
    by = df.groupBy(score).agg(F.count("*").alias("k"), F.sum(F.col(actual).cast("double")).alias("pos"))
    r = running(by, score, "k", "below").withColumn("rank", F.col("below") + (F.col("k") + 1) / 2).agg(F.sum("k").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("rank") * F.col("pos")).alias("s")).head()
    return (r.s - r.p * (r.p + 1) / 2) / (r.p * (r.n - r.p))


def split(df: DataFrame, share: float, id_col: str = "event_id", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by hash: the same whatever the partitions."""
    u = F.conv(F.substring(key(id_col, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.where(u >= share), df.where(u < share)


def fold(id_col: str = "event_id", k: int = 10, seed: int = 0) -> Column:
    return F.pmod(F.conv(F.substring(key(id_col, seed), 1, 8), 16, 10).cast("long"), F.lit(k))


@dataclass
class CellClassifier:
    """A classifier of events: scaling is fitted once on the training rows, and kept for prediction."""

    features: list[str]
    label: str = "label"
    kind: str = "logistic"
    params: dict = field(default_factory=dict)
    scale: str | None = "standard"
    balanced: bool = False

    def _estimator(self):
        from pyspark.ml import classification as C

        kinds = {"logistic": C.LogisticRegression, "random_forest": C.RandomForestClassifier, "decision_tree": C.DecisionTreeClassifier, "gbt": C.GBTClassifier, "naive_bayes": C.NaiveBayes, "svm": C.LinearSVC, "network": C.MultilayerPerceptronClassifier}
        if self.kind not in kinds:
            raise ValueError(f"unknown classifier {self.kind!r}; known: {', '.join(kinds)}")
        return kinds[self.kind](featuresCol="_v", labelCol=self.label, predictionCol="predicted", **self.params)

    def _vectors(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        scaled = self.scaler.transform(df) if self.scale else df.withColumns({f: number(f) for f in self.features})
        return VectorAssembler(inputCols=self.features, outputCol="_v", handleInvalid="skip").transform(scaled)

    def fit(self, df: DataFrame) -> CellClassifier:
        if self.scale:
            self.scaler = Scaler(self.scale).fit(df, self.features)
        data = self._vectors(df)
        estimator = self._estimator()
        if self.balanced:
            data = data.join(F.broadcast(class_weights(df, self.label).select(self.label, "weight")), self.label)
            estimator = estimator.setWeightCol("weight")
        self.model = estimator.fit(data)
        return self

    def predict(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        """df with `predicted` (and `score`, the chance of class 1, where the model has two classes)."""
        from pyspark.ml.functions import vector_to_array

        self._fitted()
        keep = df.columns
        out = self.model.transform(self._vectors(df.select("*", *[F.col(f).alias(f"_raw_{f}") for f in self.features])))
        if "probability" in out.columns:
            out = out.withColumn("score", vector_to_array("probability")[1])
            if threshold is not None:
                out = out.withColumn("predicted", (F.col("score") > threshold).cast("double"))
        restored = out.withColumns({f: F.col(f"_raw_{f}") for f in self.features})
        return restored.select(*keep, "predicted", *[c for c in ("score",) if c in out.columns])

    def cross_validate(self, df: DataFrame, k: int = 10, names: tuple[str, ...] = ("balanced_accuracy", "f1_weighted"), id_col: str = "event_id") -> list[dict[str, float]]:
        f = fold(id_col, k)
        return [metrics(CellClassifier(self.features, self.label, self.kind, self.params, self.scale, self.balanced).fit(df.where(f != i)).predict(df.where(f == i)), self.label, "predicted", names) for i in range(k)]

    def tune(self, df: DataFrame, grid: dict[str, list], k: int = 3, metric: str = "balanced_accuracy", id_col: str = "event_id") -> tuple[dict, float]:
        """The parameters of greatest mean score over folds; they extend the classifier's own."""
        import itertools

        best: tuple[dict, float] = ({}, -1.0)
        for values in itertools.product(*grid.values()):
            params = {**self.params, **dict(zip(grid, values, strict=True))}
            scores = CellClassifier(self.features, self.label, self.kind, params, self.scale, self.balanced).cross_validate(df, k, (metric,), id_col)
            if (mean := sum(s[metric] for s in scores) / k) > best[1]:
                best = (params, mean)
        return best

    def learning_curve(self, train: DataFrame, test: DataFrame, shares: tuple[float, ...] = (0.1, 0.3, 1.0), metric: str = "balanced_accuracy", id_col: str = "event_id") -> list[tuple[float, float]]:
        out = []
        for s in shares:
            part = train if s >= 1 else split(train, s, id_col, seed=1)[1]
            model = CellClassifier(self.features, self.label, self.kind, self.params, self.scale, self.balanced).fit(part)
            out.append((s, metrics(model.predict(test), self.label, "predicted", (metric,))[metric]))
        return out

    def importance(self) -> dict[str, float]:
        """Impurity importance of tree models."""
        return dict(zip(self.features, map(float, self.model.featureImportances.toArray()), strict=True))

    def permutation_importance(self, df: DataFrame, metric: str = "balanced_accuracy", id_col: str = "event_id", seed: int = 0) -> dict[str, float]:
        """How much the score falls when a column is dealt out anew within blocks of about 1000 rows: rows by one hash order, values by another, so nothing is sorted as a whole."""
        base = metrics(self.predict(df), self.label, "predicted", (metric,))[metric]
        out = {}
        block = F.pmod(F.xxhash64(id_col), F.lit(max(1, df.count() // 1000)))
        for f in self.features:
            a = df.withColumn("_b", block).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(key(id_col, seed), id_col)))
            b = df.select(block.alias("_b"), F.row_number().over(Window.partitionBy(block).orderBy(key(id_col, seed + 1), id_col)).alias("_r"), F.col(f).alias("_new"))
            shuffled = a.join(b, ["_b", "_r"]).withColumn(f, F.col("_new")).drop("_b", "_r", "_new")
            out[f] = base - metrics(self.predict(shuffled), self.label, "predicted", (metric,))[metric]
        return out

    def save(self, path: str) -> None:
        """The fitted model, and beside it what prediction needs: features, label, kind, and the scaler with its statistics."""
        self._fitted()
        self.model.write().overwrite().save(f"{path}/model")
        said = {"features": self.features, "label": self.label, "kind": self.kind, "params": self.params, "scale": self.scale, "balanced": self.balanced, "stats": self.scaler.stats if self.scale else {}}
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/classifier")

    @classmethod
    def load(cls, path: str) -> CellClassifier:
        from pyspark.ml import classification as C

        said = json.loads(SparkSession.active().read.text(f"{path}/classifier").head().value)
        stats = said.pop("stats")
        out = cls(**said)
        kinds = {"logistic": C.LogisticRegressionModel, "random_forest": C.RandomForestClassificationModel, "decision_tree": C.DecisionTreeClassificationModel, "gbt": C.GBTClassificationModel, "naive_bayes": C.NaiveBayesModel, "svm": C.LinearSVCModel, "network": C.MultilayerPerceptronClassificationModel}
        out.model = kinds[out.kind].load(f"{path}/model")
        if out.scale:
            out.scaler = Scaler(out.scale, stats=stats)
        return out

    def _fitted(self) -> None:
        if not hasattr(self, "model"):
            raise ValueError("the classifier isn't fitted")

    def set_params(self, **params) -> CellClassifier:
        """New parameters of the model, which must be fitted again."""
        self.params = {**self.params, **params}
        self.__dict__.pop("model", None)
        return self

    def transform(self, df: DataFrame, method: str | None, params: dict | None = None) -> DataFrame:
        """df with the features on another scale."""
        return transforms.apply(df, self.features, method, params)

    def downsample(self, df: DataFrame, method: str, size: int | float, id_col: str = "event_id", **kwargs) -> DataFrame:
        """Training rows: uniform, by density, or faithful (size is then the cover's radius)."""
        if method == "uniform":
            return sampling.uniform(df, size, id_col=id_col, **kwargs)
        if method == "density":
            return sampling.density_downsample(df, self.features, size, id_col=id_col, **kwargs)
        if method == "faithful":
            return sampling.faithful_downsample(df, self.features, size, id_col=id_col)
        raise ValueError(f"unknown sampling {method!r}")

    def training_data(self, events: DataFrame, membership: DataFrame, tree: list[tuple[str, str | None]], populations: list[str], root: str = P.ROOT, multi: bool = False) -> DataFrame:
        """Events of the root population with their labels; the populations must be there, and below the root population."""
        check_labels(tree, populations, root)
        rows = P.load(events, membership, root)
        return P.multilabel(rows, membership, populations) if multi else P.singlelabel(rows, membership, populations)

    def validate(self, events: DataFrame, membership: DataFrame, tree: list[tuple[str, str | None]], populations: list[str], root: str = P.ROOT, threshold: float | None = None, names: tuple[str, ...] = ("balanced_accuracy", "f1_weighted")) -> tuple[dict[str, float], DataFrame]:
        """Scores against a gated sample, and its events with `label` and `predicted`."""
        self._fitted()
        done = self.predict(self.training_data(events, membership, tree, populations, root), threshold)
        return metrics(done, "label", "predicted", names), done

    def performance(self, train: DataFrame, test: DataFrame, names: tuple[str, ...] = ("balanced_accuracy", "f1_weighted")) -> list[dict]:
        """Scores on the rows it was fitted on and on others."""
        self._fitted()
        return [{"data": n, **metrics(self.predict(df), self.label, "predicted", names)} for n, df in (("train", train), ("test", test))]

    def prune(self, train: DataFrame, test: DataFrame, depths: list[int], metric: str = "accuracy") -> list[tuple[int, float]]:
        """The score of a tree of each greatest depth."""
        out = []
        for d in depths:
            model = CellClassifier(self.features, self.label, self.kind, {**self.params, "maxDepth": d}, self.scale, self.balanced).fit(train)
            out.append((d, metrics(model.predict(test), self.label, "predicted", (metric,))[metric]))
        return out

    def rules(self) -> str:
        """A tree model as text."""
        self._fitted()
        out = self.model.toDebugString
        for i, f in enumerate(self.features):
            out = re.sub(rf"\bfeature {i}\b", f, out)
        return out


def check_labels(tree: list[tuple[str, str | None]], populations: list[str], root: str = P.ROOT) -> None:
    """An error unless the populations are in the tree, and below the root population."""
    known = dict(tree)
    if missing := [p for p in populations if p not in known]:
        raise ValueError(f"no population {', '.join(missing)}")
    if wrong := [p for p in populations if not P._is_below(p, root, known)]:
        raise ValueError(f"{', '.join(wrong)}: not below {root}")


def residuals(df: DataFrame, features: list[str], label: str, strength: float, share: float = 0.5, id_col: str = "event_id") -> DataFrame:
    """id, predicted, residual on held-out rows, of a linear model with an L1 penalty."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    train, test = split(df, share, id_col)
    scaler = Scaler().fit(train, features)
    vectors = lambda d: VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip").transform(scaler.transform(d)).select(id_col, "_v", F.col(label).cast("double").alias("_y"))
    model = LinearRegression(featuresCol="_v", labelCol="_y", predictionCol="predicted", regParam=strength, elasticNetParam=1.0, standardization=False).fit(vectors(train))
    return model.transform(vectors(test)).select(id_col, "predicted", (F.col("_y") - F.col("predicted")).alias("residual"))


def as_populations(df: DataFrame, prefix: str, names: dict[int, str], id_col: str = "event_id") -> DataFrame:
    """Membership rows of predicted labels; 0 is unclassified."""
    known = F.create_map(*[F.lit(v) for kv in {**{0: "Unclassified"}, **names}.items() for v in kv])
    return df.select("sample_id", id_col, F.concat_ws("_", F.lit(prefix), known[F.col("predicted").cast("int")]).alias("population"))


def l1_path(df: DataFrame, features: list[str], label: str, strengths: list[float], kind: str = "logistic") -> DataFrame:
    """strength, feature, coefficient along a path of L1 penalties."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    data = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip").transform(Scaler().fit(df, features).transform(df)).select("_v", F.col(label).cast("double").alias("_y")).cache()
    rows = []
    for s in strengths:
        make = LogisticRegression if kind == "logistic" else LinearRegression
        model = make(featuresCol="_v", labelCol="_y", regParam=s, elasticNetParam=1.0, standardization=False).fit(data)
        rows += [(float(s), f, float(c)) for f, c in zip(features, model.coefficients.toArray(), strict=True)]
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "strength double, feature string, coefficient double")
