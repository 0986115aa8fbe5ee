"""Groups of sprint athletes on their feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .clusters import kmeans_labels
from .components import scores, spectrum
from .loads import FEATURES, athlete_features, fill_with_means
from .matrix import matrix_of


def cluster_athletes(sprints: DataFrame, k: int = 3) -> DataFrame:
    """Features, cluster (on the standardised features) and two component scores per client."""
    features = settle(fill_with_means(athlete_features(sprints)))
    matrix = matrix_of(features, "client", FEATURES)
    labels = kmeans_labels(matrix.standardized(), "client", FEATURES, min(k, matrix.n)).select("client", "cluster")
    points = scores(matrix, spectrum(matrix), 2)
    return features.select("client", *FEATURES).join(labels, "client").join(points, "client")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Size, mean best speed and mean retention per cluster; members stay rows of ``clustered``."""
    return clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"),
        F.avg("max_speed").alias("avg_max_speed"),
        F.avg("retention").alias("avg_retention"),
    )
