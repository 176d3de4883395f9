"""Writers: cluster tables, cluster lists a group at a time, label files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinset.operators.groups import with_ordinal
from kinset.operators.joins import attach
from kinset.operators.labels import cluster_radius, cluster_sizes

FORMATS = ("parquet", "json", "text")
#: What a line of a cluster list holds after the group's columns.
LISTS = "part long, clusters array<struct<center: long, radius: double, size: long, members: array<struct<id: long, seq: string>>>>"


def write_clusters(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a cluster table; an existing path is an error.

    ``text`` writes one JSON object per line of a plain text file.
    """
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {format!r}")
    if format == "text":
        df = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    df.write.mode("errorifexists").format(format).save(path)


def cluster_lists(
    df: DataFrame, members: DataFrame, group: Sequence[str], metric: str, list_rows: int
) -> DataFrame:
    """One row for each group with its clusters: centre, radius, size and members (id, seq).

    Clusters are ordered by centre, members by id. A group of more than ``list_rows`` records takes
    several rows, numbered by ``part``, so that no row grows with the group; a cluster may then
    go on in the next row, under the same centre, radius and size. The centre is the record whose
    id names the cluster; the radius is null where no distance to it is defined.
    """
    records = df.select(F.col("id").cast("bigint").alias("id"), "seq")
    placed = members.select(*group, "id", "cluster_id").join(records, "id")
    numbered = with_ordinal(placed, ["cluster_id", "id"], group, "_number")
    numbered = numbered.withColumn("part", F.expr(f"_number div {int(list_rows)}"))
    member = F.struct("id", "seq")
    clusters = numbered.groupBy(*group, "part", "cluster_id").agg(F.array_sort(F.collect_list(member)).alias("members"))
    known = cluster_radius(df, members, group, metric).select("cluster_id", "radius", "size")
    clusters = attach(clusters, known, ["cluster_id"], members.count())
    one = F.struct(F.col("cluster_id").alias("center"), "radius", "size", "members")
    return clusters.groupBy(*group, "part").agg(F.array_sort(F.collect_list(one)).alias("clusters"))


def write_cluster_lists(lists: DataFrame, group: Sequence[str], path: str) -> None:
    """``cluster_lists`` as text, one JSON object a line, in the order of the groups and parts: part
    files in name order are the whole. An existing path is an error."""
    order = [*group, "part"]
    lines = lists.repartitionByRange(*order).sortWithinPartitions(*order)
    lines = lines.select(F.to_json(F.struct(*lists.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("errorifexists").text(path)


def read_cluster_lists(spark: SparkSession, path: str, group: T.StructType | str) -> DataFrame:
    """Members ``(group, part, center, radius, size, id, seq)`` from files of ``write_cluster_lists``.

    ``group`` is the schema of the group's columns.
    """
    columns = T._parse_datatype_string(group) if isinstance(group, str) else group
    schema = T.StructType([*columns.fields, *T._parse_datatype_string(LISTS).fields])
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")
    rows = rows.select(*columns.fieldNames(), "part", F.explode("clusters").alias("c"))
    rows = rows.select(*columns.fieldNames(), "part", "c.center", "c.radius", "c.size", F.explode("c.members").alias("m"))
    return rows.select(*columns.fieldNames(), "part", "center", "radius", "size", "m.id", "m.seq")


def write_labels(labels: DataFrame, path: str) -> None:
    """One label per line in id order; part files in name order are the whole."""
    ordered = labels.repartitionByRange("id").sortWithinPartitions("id")
    ordered.select(F.col("label").cast("string").alias("value")).write.mode("errorifexists").text(
        path
    )


def group_labels(members: DataFrame, by: Sequence[str]) -> DataFrame:
    """Labels (by, id, label) numbered from 0 within each of ``by`` (such as method and group), in the
    order of the cluster ids."""
    sizes = cluster_sizes(members, by)
    numbers = with_ordinal(sizes.select(*by, "cluster_id"), ["cluster_id"], by, "label")
    return attach(members.select(*by, "id", "cluster_id"), numbers, [*by, "cluster_id"], members.count(), "inner").drop("cluster_id")


def write_group_labels(labels: DataFrame, by: Sequence[str], path: str) -> None:
    """Label files for each of ``by`` (such as method and group): a folder for each of its values, one
    label a line in the order of the ids.

    The rows are range-partitioned by ``by`` and id, so a small group is one file, and a large one is
    several whose name order is the order of the ids. An existing path is an error.
    """
    order = [*by, "id"]
    ordered = labels.repartitionByRange(*order).sortWithinPartitions(*order)
    lines = ordered.select(*by, F.col("label").cast("string").alias("value"))
    lines.write.mode("errorifexists").partitionBy(*by).text(path)


def read_group_labels(spark: SparkSession, path: str, by: T.StructType | str) -> DataFrame:
    """(by, line, label) from files of ``write_group_labels``, lines numbered from 0 within each folder.

    ``by`` is the schema of the folders' columns. Files are read in pieces; a line's number is its
    place by file name and position.
    """
    columns = T._parse_datatype_string(by) if isinstance(by, str) else by
    names = columns.fieldNames()
    schema = T.StructType([T.StructField("value", T.StringType()), *columns.fields])
    rows = spark.read.schema(schema).text(path).select(
        *names, F.col("value").cast("bigint").alias("label"),
        F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return with_ordinal(rows, ["_file", "_block", "_row"], names, "line").select(*names, "line", "label")
