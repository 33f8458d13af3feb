"""The compared methods and their default settings (ML5, ML6, ML12, ML13, ML17, ML18, ML20)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor


# Split candidates of a feature: enough for every day of a year in part and for fine weather values.
BINS = 256


@dataclass(frozen=True)
class Method:
    """One way to solve a task. ``weights`` names how classes are weighted: none, balanced,
    pos (negatives / positives), cost (miss costs 4) or cost_pos (both)."""

    name: str
    kind: str
    trees: int = 0
    depth: int = 0
    step: float = 0.1
    min_leaf: int = 1
    weights: str = "none"
    scaled: bool = False
    seed: int = 42
    bootstrap: bool = True

    def with_(self, **changes) -> "Method":
        return replace(self, **changes)

    @property
    def classifier(self) -> bool:
        return self.kind.endswith("_classifier") or self.kind == "logistic"

    def estimator(self, label: str):
        """Spark's own ensemble, for zones too large for one task."""
        common = {"featuresCol": "features", "labelCol": label}
        if self.weights != "none":
            common["weightCol"] = "class_weight"
        tree = {"maxDepth": self.depth, "minInstancesPerNode": self.min_leaf, "seed": self.seed, "maxMemoryInMB": 512, "maxBins": BINS, "cacheNodeIds": True}
        forest = {"bootstrap": self.bootstrap, **tree}
        if self.kind == "rf_regressor":
            return RandomForestRegressor(numTrees=self.trees, featureSubsetStrategy="all", **forest, **common)
        if self.kind == "gbt_regressor":
            return GBTRegressor(maxIter=self.trees, stepSize=self.step, **tree, **common)
        if self.kind == "rf_classifier":
            return RandomForestClassifier(numTrees=self.trees, featureSubsetStrategy="sqrt", **forest, **common)
        if self.kind == "gbt_classifier":
            return GBTClassifier(maxIter=self.trees, stepSize=self.step, **tree, **common)
        raise ValueError(f"no estimator for {self.kind}")


# Fixed settings of the compared methods.
LOAD_METHODS = {
    "linear": Method("linear", "ols"),
    "random_forest": Method("random_forest", "rf_regressor", trees=100, depth=20, min_leaf=5),
    "boosted_trees": Method("boosted_trees", "gbt_regressor", trees=100, depth=8, step=0.1),
}
PEAK_HOUR_METHODS = {
    "linear": Method("linear", "ols"),
    "random_forest": Method("random_forest", "rf_classifier", trees=100, depth=15, weights="balanced"),
    "boosted_trees": Method("boosted_trees", "gbt_classifier", trees=100, depth=8, step=0.1, weights="pos"),
    "historical": Method("historical", "historical"),
}
PEAK_DAY_METHODS = {
    "random_forest": Method("random_forest", "rf_classifier", trees=200, depth=15, min_leaf=10, weights="cost"),
    "boosted_trees": Method("boosted_trees", "gbt_classifier", trees=200, depth=8, step=0.05, weights="cost_pos"),
    "logistic": Method("logistic", "logistic", trees=1000, weights="cost", scaled=True),
}


def smaller(methods: dict[str, Method], trees: int, depth: int) -> dict[str, Method]:
    """The same methods with at most ``trees`` trees of ``depth``, for trial runs."""
    return {
        k: m.with_(trees=min(m.trees, trees), depth=min(m.depth, depth)) if m.depth else m for k, m in methods.items()
    }
