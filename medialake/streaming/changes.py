"""Incremental ingest as a log of changes: a batch writes only the rows that it brings, readers merge, compaction folds the log into snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType


@dataclass(frozen=True)
class ChangeLog:
    """A table as changes under ``base``: rows of ``schema`` by ``key``; the row of the greatest (``order``, batch) counts.

    ``preserve`` are the user's own columns: of them the value that arrived first, if it isn't null or empty, stays. ``buckets`` is the number of files
    that a batch writes at most, and the unit of compaction; it is fixed for the table's life.
    """

    base: str
    schema: StructType
    key: str
    order: str
    preserve: tuple[str, ...] = ()
    buckets: int = 64

    def _said(self, spark: SparkSession, rows: list[tuple[str, int, int]]) -> None:
        spark.createDataFrame(rows, "kind string, number int, bucket int").coalesce(1).write.mode("append").parquet(f"{self.base}/commits")  # a few numbers

    def _commits(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("kind string, number int, bucket int").parquet(f"{self.base}/commits")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _written(self, spark: SparkSession, part: str, number: str) -> DataFrame:
        schema = StructType(list(self.schema.fields)).add(number, IntegerType()).add("_bucket", IntegerType())
        return spark.read.schema(schema).parquet(f"{self.base}/{part}")

    def add(self, batch: DataFrame, number: int) -> None:
        """Writes one batch: of each key the last row, by order and then by all its columns, with what the batch says first of the user's columns.

        A batch that is replayed overwrites what it wrote.
        """
        rows = batch.select(*self.schema.names).withColumn("_batch", F.struct(F.lit(number).alias("n"), F.to_json(F.struct(*self.schema.names)).alias("row")))
        self._merged(rows).withColumn("_bucket", self._bucket()).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(f"{self.base}/log/_number={number}")
        self._said(batch.sparkSession, [("batch", number, -1)])

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row for each key of ``rows``, which have ``_batch``; partial sums before anything moves."""
        age, arrival = F.struct(self.order, "_batch"), F.struct("_batch.n", self.order, "_batch.row")
        plain = [c for c in self.schema.names if c != self.key and c not in self.preserve]
        newest = F.max_by(F.struct(*plain), age).alias("_newest")
        own = []
        for c in self.preserve:
            said = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
            own.append(F.coalesce(F.min_by(F.when(said, F.col(c)), F.when(said, arrival)), F.max_by(c, age)).alias(c))
        return rows.groupBy(self.key).agg(newest, *own).select(*(F.col(f"_newest.{c}").alias(c) if c in plain else F.col(c) for c in self.schema.names))

    def _parts(self, spark: SparkSession, buckets: DataFrame | None = None) -> DataFrame:
        """Rows that count: of each bucket its newest whole snapshot and the committed batches behind it."""
        commits = self._commits(spark)
        upto = commits.where("kind = 'snapshot'").groupBy(F.col("bucket").alias("_bucket")).agg(F.max("number").alias("_upto"))  # as many rows as buckets at most
        whole = commits.where("kind = 'batch'").select(F.col("number").alias("_number")).distinct()
        log = self._written(spark, "log", "_number").join(F.broadcast(whole), "_number", "left_semi").join(F.broadcast(upto), "_bucket", "left").where("_upto is null or _number > _upto").drop("_upto")
        if commits.where("kind = 'snapshot'").limit(1).count():
            newest = upto.select(F.col("_bucket").alias("_of"), "_upto")
            held = self._written(spark, "snapshot", "_number").join(F.broadcast(newest), (F.col("_number") == F.col("_upto")) & (F.col("_bucket") == F.col("_of")), "left_semi")
            log = log.unionByName(held)
        return log if buckets is None else log.join(F.broadcast(buckets), "_bucket", "left_semi")

    def current(self, spark: SparkSession) -> DataFrame:
        """The table as it is: merged on reading; a key's rows are in one bucket, so only as many rows as changed since the last snapshot are merged with it."""
        return self._merged(self._parts(spark).withColumn("_batch", F.struct(F.col("_number").alias("n"), F.lit("").alias("row"))))

    def compact(self, spark: SparkSession) -> list[int]:
        """Folds the buckets that batches have touched since their last snapshot into new ones; gives their numbers. Other buckets are not read or written.

        Readers see a new snapshot once its commit is written, and the old one until then; a compaction that fails leaves no trace that counts.
        """
        commits = self._commits(spark)
        last = commits.where("kind = 'batch'").agg(F.max("number")).first()[0]
        if last is None:
            return []
        upto = commits.where("kind = 'snapshot'").groupBy(F.col("bucket").alias("_bucket")).agg(F.max("number").alias("_upto"))
        touched = self._written(spark, "log", "_number").select("_number", "_bucket").distinct().join(F.broadcast(upto), "_bucket", "left").where("_upto is null or _number > _upto")
        chosen = sorted(r[0] for r in touched.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
        if not chosen:
            return []
        of = spark.createDataFrame([(b,) for b in chosen], "_bucket int")
        rows = self._parts(spark, of).where(F.col("_number") <= last).withColumn("_batch", F.struct(F.col("_number").alias("n"), F.lit("").alias("row")))
        self._merged(rows).withColumn("_bucket", self._bucket()).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(f"{self.base}/snapshot/_number={last}")
        self._said(spark, [("snapshot", last, b) for b in chosen])
        return chosen

    def ingest(self, stream: DataFrame, checkpoint: str):
        """Starts a query that adds each micro-batch of a stream, until its input is used up; a restart goes on behind the last one."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def touched_rows(spark: SparkSession, log: ChangeLog) -> DataFrame:
    """(number, rows): how many rows each committed batch wrote."""
    batches = log._commits(spark).where("kind = 'batch'").select(F.col("number").alias("_number")).distinct()
    return log._written(spark, "log", "_number").join(F.broadcast(batches), "_number").groupBy(F.col("_number").alias("number")).agg(F.count("*").alias("rows"))

