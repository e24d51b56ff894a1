"""Tables in the shared folder, and the connected components that are computed with them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES, ROW_GROUP = 4 << 20, 16 << 20
PART_BYTES = 4 << 20
_LIMIT, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; with any other master that is an error, as executors would
    write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bounded(df: DataFrame) -> DataFrame:
    """df; from now on its session's Arrow batches hold 4 MB at most, unless the session has a limit of its own.

    Set once and left, as results that are computed later need it as well; queries side by side all want the same.
    """
    spark = df.sparkSession
    if spark.conf.get(_LIMIT) == _DEFAULT:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    return df


def many(*tables: DataFrame) -> tuple[int, ...]:
    """What repartition() takes before its keys so that a task's share does not grow with the tables: a partition for each PART_BYTES of
    the files they are read from.  Empty where the session's own number of partitions is as large: then Spark may merge small ones.
    """
    spark = tables[0].sparkSession
    conf, path = spark._jsparkSession.sessionState().newHadoopConf(), spark._jvm.org.apache.hadoop.fs.Path
    files = [path(spark._jvm.java.net.URI(f)) for f in {f for t in tables for f in t.inputFiles()}]
    n = -(-sum(f.getFileSystem(conf).getFileStatus(f).getLen() for f in files) // PART_BYTES)
    return (n,) if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else ()


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table of its own in the shared folder and reads it: cuts lineage, survives lost executors."""
    spark = bounded(df).sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of kept() that nothing reads any more, as those of a loop's earlier rounds."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_kept_at", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id: the smallest id reachable) of every id in links; ids in no link are not returned.

    Contraction: each round every node takes the name of its neighbour (or itself) that comes first in a hash order of the ids,
    links are renamed and duplicates and loops go, until no link is left; then all nodes of a component have one name.  By the
    hash, chains of ascending ids contract like any others.  All steps are partial aggregations and joins.
    """
    edges = kept(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    labels = kept(edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct().withColumn("label", F.col("id")), "labels")
    place = lambda c: F.struct(F.xxhash64(F.lit(11), c).alias("h"), F.col(c).alias("id"))
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        least = kept(both.groupBy("u").agg(F.min(place("v")).alias("near")).select("u", F.least("near", place("u"))["id"].alias("to")), "least")
        named = labels.join(least.withColumnRenamed("u", "label"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        new_labels = kept(named, "labels")
        new_edges = kept(
            edges.join(least.select("u", F.col("to").alias("x")), "u")
            .join(least.select(F.col("u").alias("v"), F.col("to").alias("y")), "v")
            .where("x <> y")
            .select(F.col("x").alias("u"), F.col("y").alias("v"))
            .distinct(),
            "edges",
        )
        dropped(edges, labels, least)
        edges, labels = new_edges, new_labels
    first = labels.groupBy("label").agg(F.min("id").alias("component_id"))
    return labels.join(first, "label").select("id", "component_id")
