"""Wide categories without level lists (M9, M16): hashed sparse features.

A ``FeatureHasher`` maps ``column=value`` to one of ``width`` slots, so nothing is
fitted, no label of a level reaches the driver, and a level never seen before has
its slot too.  Two levels share a slot with probability 1 / width: of n levels
about n^2 / (2 width) pairs collide, so choose ``width`` well above the number of levels that
matter.  Models hold dense vectors of ``width`` numbers per centre or statistic,
a size set by the parameter, not by the data.  Null values have no slot.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import FeatureHasher, StringIndexer
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 1 << 18


def hasher(categorical: list[str], numeric: list[str] = (), width: int = WIDTH, out: str = "features") -> FeatureHasher:
    """Categorical columns one slot a value, numeric columns one slot each."""
    return FeatureHasher(inputCols=[*categorical, *numeric], categoricalCols=list(categorical), numFeatures=width, outputCol=out)


def hashed_kmeans(categorical: list[str], k: int = 4, width: int = WIDTH, seed: int = 42, init_mode: str = "k-means||",
                  prediction_col: str = "cluster") -> Pipeline:
    """M9 on hashed columns: k centres of ``width`` numbers each."""
    return Pipeline(stages=[hasher(categorical, width=width),
                            KMeans(k=k, seed=seed, initMode=init_mode, featuresCol="features", predictionCol=prediction_col)])


def hashed_forest(label: str, categorical: list[str], trees: int = 20, width: int = 1024, seed: int = 42, depth: int = 5,
                  subset: str = "auto") -> Pipeline:
    """M16 on hashed columns; the class names (few) are indexed, the features are not.

    A tree looks for splits over all slots, so the width is smaller here; ``subset``
    is the share of slots a node looks at (``all`` where few slots matter)."""
    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="frequencyDesc"), hasher(categorical, width=width),
                            RandomForestClassifier(featuresCol="features", labelCol="label_idx", numTrees=trees, seed=seed, maxDepth=depth,
                                                   featureSubsetStrategy=subset)])


def squared_distances(features: str, centres) -> Column:
    """Squared distance of a row's vector to every centre, as an array in their order.

    |v - c|^2 is summed as |c|^2 plus x (x - 2 c_i) over the slots i that the row holds, so a row costs its few values
    a centre, not ``width`` of them."""
    held = F.unwrap_udt(features)  # a dense vector holds every slot and lists none
    values = held["values"]
    slots = F.coalesce(held["indices"], F.sequence(F.lit(0), F.size(values) - 1))

    def distance(centre) -> Column:
        c = F.array(*[F.lit(float(x)) for x in centre])
        terms = F.zip_with(slots, values, lambda i, x: x * (x - 2 * F.get(c, i)))
        return F.aggregate(terms, F.lit(float(sum(float(x) ** 2 for x in centre))), lambda s, x: s + x)

    return F.array(*[distance(c) for c in centres])
