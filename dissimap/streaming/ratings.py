"""The rating queue as a stream: statistics kept up to date batch by batch."""

from __future__ import annotations

import logging
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dissimap.operators.rated_pairs import PIECE
from dissimap.operators.ratings import PART_PAIRS, RELATION, gather_pieces, item_statistics, merge_statistics, pair_pieces, relation_statistics, validate_items, validate_relations

QUEUE = "user_id bigint, item_id bigint, value double"
MOVED = "id bigint, x double, y double, vx double, vy double"
#: Parts of the relations' increments, a power of two; relations() puts parts together while they are small.
RELATION_PARTS = 1024

log = logging.getLogger(__name__)


def run_stream(writer, recursive: bool) -> None:
    """Runs a stream over what is there: all of it, or, not recursive, its first batch alone."""
    if recursive:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    q = writer.trigger(processingTime="1 day").start()  # the first batch starts at once, the next one never
    try:
        while q.isActive and not q.recentProgress:
            q.awaitTermination(1)
    finally:
        q.stop()
    if q.exception():
        raise q.exception()


class RatingMap:
    """Ratings and statistics as tables in a folder: queue/ (appended files), ratings/, items/ and relations/, with a new folder for each batch: of items/ all
    statistics, of relations/ what the batch adds to them (packed pairs, see rated_pairs), which relations() sums. A batch that is run again after a failure
    writes the same folder again, so its ratings count once.

    A batch counts its own ratings and the pairs that they make, with each other and with older ratings of the same users; what older ratings make among
    themselves is not counted again. relations=False keeps items only. file_rows: the most ratings of a queued file, which is the unit of batches.

    A rating never replaces another: re-ratings accumulate. Ratings without user, item or value, or with NaN, are left out. There is no event time and no
    watermark: late ratings count.
    """

    def __init__(self, spark: SparkSession, folder: str, relations: bool = True, file_rows: int = 100_000):
        self.spark, self.folder, self.with_relations, self.file_rows = spark, folder.rstrip("/"), relations, file_rows

    # The folder's state

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _last(self, before: int | None = None) -> int:
        """The latest complete batch (before another), -1 if there is none."""
        jvm, path = self.spark.sparkContext._jvm, f"{self.folder}/items"
        if not self._exists(path):
            return -1
        p = jvm.org.apache.hadoop.fs.Path(path)
        names = [s.getPath().getName() for s in p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
        done = [int(n[6:]) for n in names if n.startswith("batch=") and self._exists(f"{path}/{n}/_SUCCESS")]
        return max((d for d in done if before is None or d < before), default=-1)

    def _read(self, table: str, batch: int, schema: str) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}/batch={batch}")

    ITEMS = "item_id bigint, n bigint, m_v double, c_v_v double"

    # The queue

    def queue_ratings(self, ratings: DataFrame) -> None:
        """Appends (user_id, item_id, value)."""
        ratings.select("user_id", "item_id", F.col("value").cast("double").alias("value")).write.option("maxRecordsPerFile", self.file_rows).mode("append").parquet(f"{self.folder}/queue")

    def queue_depth(self) -> int:
        """Ratings queued and not yet processed."""
        if not self._exists(f"{self.folder}/queue"):
            return 0
        taken = self.spark.read.schema("batch int, n bigint").parquet(f"{self.folder}/taken") if self._exists(f"{self.folder}/taken") else None
        done = 0 if taken is None else taken.select("batch", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return self.spark.read.schema(QUEUE).parquet(f"{self.folder}/queue").count() - done

    def process_rating_queue(self, batch_size: int | None = None, recursive: bool = True, validate: bool = False) -> int:
        """Processes queued ratings and returns how many are left. batch_size: the most ratings of a batch, in whole files of file_rows at most (one file at
        least); None, all. recursive: batch after batch until the queue is empty; otherwise one batch. validate: then compares the statistics with
        those of all ratings, and raises ValueError if any is off by 0.1 %."""
        if not self.queue_depth():
            return 0
        reader = self.spark.readStream.schema(QUEUE)
        if batch_size:
            reader = reader.option("maxFilesPerTrigger", max(1, batch_size // self.file_rows))
        w = reader.parquet(f"{self.folder}/queue").writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/checkpoint")
        run_stream(w, recursive)
        if validate:
            self.validate()
        return self.queue_depth()

    def _batch(self, df: DataFrame, batch: int) -> None:
        n = df.count()
        log.info("batch %d of %s: %d ratings", batch, self.folder, n)
        new = df.where("user_id is not null and item_id is not null and value is not null and not isnan(value)")
        new.write.mode("overwrite").parquet(f"{self.folder}/ratings/batch={batch}")
        new = self.spark.read.schema(QUEUE).parquet(f"{self.folder}/ratings/batch={batch}")
        last = self._last(batch)
        fresh = item_statistics(new)
        fresh = fresh.select("item_id", F.col("sample_count").alias("n"), F.col("value_mean").alias("m_v"), (F.col("value_variance") * F.col("sample_count")).alias("c_v_v"))
        items = merge_statistics(self._read("items", last, self.ITEMS), fresh, ["item_id"])
        if self.with_relations:
            self._relations(new, batch).write.mode("overwrite").parquet(f"{self.folder}/relations/batch={batch}")
        self.spark.createDataFrame([(batch, n)], "batch int, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/taken/part={batch}")
        items.write.mode("overwrite").parquet(f"{self.folder}/items/batch={batch}")  # last: it completes the batch

    def _relations(self, new: DataFrame, batch: int) -> DataFrame:
        """The pairs that a batch adds: new ratings with new ones, and with the same users' old ones."""
        marked, before = new.withColumn("fresh", F.lit(True)), self.ratings(batch)
        if before is not None:
            old = before.join(new.select("user_id").distinct(), "user_id", "left_semi")
            marked = marked.unionByName(old.withColumn("fresh", F.lit(False)))
        return pair_pieces(marked, fresh=True, parts=RELATION_PARTS)[0]

    # Results

    def ratings(self, before: int | None = None) -> DataFrame | None:
        """All ratings processed (in batches before another)."""
        if not self._exists(f"{self.folder}/ratings"):
            return None
        r = self.spark.read.schema(QUEUE + ", batch int").parquet(f"{self.folder}/ratings")
        return (r if before is None else r.where(F.col("batch") < before)).select("user_id", "item_id", "value")

    def items(self) -> DataFrame:
        """(item_id, sample_count, value_mean, value_variance)."""
        i = self._read("items", self._last(), self.ITEMS)
        return i.select("item_id", F.col("n").alias("sample_count"), F.col("m_v").alias("value_mean"), (F.col("c_v_v") / F.col("n")).alias("value_variance"))

    def relations(self) -> DataFrame:
        """As relation_statistics()."""
        last = self._last()
        if last < 0 or not self._exists(f"{self.folder}/relations"):
            return gather_pieces(self.spark.createDataFrame([], PIECE), 1, "moments")
        p = self.spark.read.schema(PIECE + ", batch int").parquet(f"{self.folder}/relations").where(F.col("batch") <= last).drop("batch")
        pairs = p.agg(F.sum("n")).first()[0] or 0
        parts = min(RELATION_PARTS, 1 << max(0, math.ceil(math.log2(max(1.0, pairs / PART_PAIRS)))))
        return gather_pieces(p.withColumn("p", F.col("p").bitwiseAND(parts - 1)), parts, "moments")

    def validate(self, tolerance: float = 0.001) -> None:
        """Raises ValueError if the statistics are not those of all ratings processed."""
        r = self.ratings()
        if r is None:
            return
        if not self.with_relations:
            bad = validate_items(self.items().withColumnRenamed("item_id", "id"), item_statistics(r), tolerance).count()
            if bad:
                raise ValueError(f"{bad} items differ from the ratings")
            return
        bad = validate_items(self.items().withColumnRenamed("item_id", "id"), item_statistics(r), tolerance).count()
        # A variance that is 0 in truth may be a rounding error in a running sum: it counts as 0.
        tidy = self.relations().select("first_item_id", "second_item_id", *[F.when(F.abs(c) < 1e-9, 0.0).otherwise(F.col(c)).alias(c) if c != "sample_count" else F.col(c) for c in RELATION])
        truth = relation_statistics(r)
        truth = truth.select("first_item_id", "second_item_id", *[F.when(F.abs(c) < 1e-9, 0.0).otherwise(F.col(c)).alias(c) if c != "sample_count" else F.col(c) for c in RELATION])
        worse = validate_relations(tidy, truth, tolerance).count()
        if bad or worse:
            raise ValueError(f"{bad} items and {worse} relations differ from the ratings")


class AdjustmentQueue:
    """Items to be moved: ids appended to a folder and taken once. file_rows: the most ids of a queued file, which is the unit of batches."""

    def __init__(self, spark: SparkSession, folder: str, file_rows: int = 100_000):
        self.spark, self.folder, self.file_rows = spark, folder.rstrip("/"), file_rows

    def queue_adjustments(self, ids: list[int] | DataFrame) -> None:
        """Appends ids, or a table's column id; none, nothing."""
        if not isinstance(ids, DataFrame):
            if not ids:
                return
            ids = self.spark.createDataFrame([(int(i),) for i in ids], "id bigint")
        ids.select("id").write.option("maxRecordsPerFile", self.file_rows).mode("append").parquet(f"{self.folder}/adjustments")

    def moved(self, out: str, before: int | None = None) -> DataFrame:
        """The last place and velocity of each item moved so far (in batches before another): (id, x, y, vx, vy)."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], MOVED)
        m = self.spark.read.schema(MOVED + ", batch int").parquet(out)
        m = m if before is None else m.where(F.col("batch") < before)
        return m.groupBy("id").agg(F.max_by(F.struct("x", "y", "vx", "vy"), "batch").alias("s")).select("id", "s.x", "s.y", "s.vx", "s.vy")

    def process_adjustment_queue(self, item: DataFrame, relations: DataFrame, out: str, batch_size: int | None = None, **limits) -> None:
        """Moves the queued items by adjust_items() and writes (id, x, y, vx, vy) to out, a folder for each batch. batch_size: the most ids of a batch, in whole files
        (one at least). An id queued several times in a batch moves once. A batch starts from the places and velocities that earlier ones left."""
        from dissimap.operators.layout import adjust_items

        reader = self.spark.readStream.schema("id bigint")
        if batch_size:
            reader = reader.option("maxFilesPerTrigger", max(1, batch_size // self.file_rows))

        def run(df: DataFrame, batch: int) -> None:
            before = self.moved(out, batch)
            place = before.select("id", F.col("x").alias("mx"), F.col("y").alias("my"))
            at = item.join(place, "id", "left").withColumns({"x": F.coalesce("mx", "x"), "y": F.coalesce("my", "y")}).drop("mx", "my")
            adjust_items(at, relations, df, velocity=before, **limits).write.mode("overwrite").parquet(f"{out}/batch={batch}")

        run_stream(reader.parquet(f"{self.folder}/adjustments").writeStream.foreachBatch(run).option("checkpointLocation", f"{self.folder}/adjustment_checkpoint"), True)
