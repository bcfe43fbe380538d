"""The feature matrix: one row for each feature with a dense vector of counts, and what is known of its columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeatureMatrix:
    """df has columns feature (string) and counts (array of doubles, one for each of `samples`); k = 0: any names."""

    df: DataFrame
    samples: list[str]
    k: int = 0
    stranded: bool = True
    nf: list[float] = field(default_factory=list)
    feature_name: str = "feature"

    def with_df(self, df: DataFrame) -> FeatureMatrix:
        return replace(self, df=df)

    def long(self) -> DataFrame:
        """feature, sample_idx, value."""
        return self.df.select("feature", F.posexplode("counts").alias("sample_idx", "value"))


def from_long(long: DataFrame, samples: list[str], **more) -> FeatureMatrix:
    """A matrix from rows (feature, sample_idx, cnt), each cell at most once; cells that don't occur are 0."""
    cells = long.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("sample_idx", F.col("cnt").cast("double")))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(len(samples) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return FeatureMatrix(cells.select("feature", dense.alias("counts")), samples, **more)
