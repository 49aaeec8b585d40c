"""Clusters and their members kept under a folder, so that later calls read them instead of grouping again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ClusterStore:
    """Parquet tables ``clusters`` and ``members`` of one scope per sub-folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def put(self, scope_hash: str, clusters: DataFrame, members: DataFrame) -> None:
        """Store a page of clusters with all their members; members are laid out by cluster."""
        clusters.write.mode("overwrite").parquet(f"{self.folder}/{scope_hash}/clusters")
        stored = self.spark.read.parquet(f"{self.folder}/{scope_hash}/clusters").select("cluster_id")
        kept = members.join(stored, "cluster_id", "left_semi")
        kept.sortWithinPartitions("cluster_id", "place").write.mode("overwrite").parquet(f"{self.folder}/{scope_hash}/members")

    def scope(self, scope_hash: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{scope_hash}/clusters")

    def members(self, scope_hash: str, cluster_id: str) -> DataFrame:
        """Members of a cluster in order; the filter reaches the row groups."""
        return self.spark.read.parquet(f"{self.folder}/{scope_hash}/members").where(F.col("cluster_id") == cluster_id).orderBy("place")
