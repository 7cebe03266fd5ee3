"""Documents as a base and a change log, merged on read.

A change is appended to the log and the base is left alone. Both are tables
bucketed by id into the same number of buckets, so reading folds the log and joins
it with the base without shuffling either of them. ``compact`` writes what a read
gives as the next base, with an empty log.

The log keeps per row what a change sets: tags, seo, the whole metadata, or the
tombstone (its instant, and its reason where a trigger tag set it). Each field's
last change counts; a metadata document replaces what earlier changes put into it,
later tombstones are laid over it. A deletion is final. Changes are numbered by
``seq``, which the caller gives, higher for later batches; one batch holds one
change per id (see ``one_per_key``), so ties do not arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType, TimestampType

from folio.functions import metadata as M
from folio.functions.common import rfc3339
from folio.functions.visibility import first_trigger_tag, tombstone_at
from folio.operators.merges import _days_after, one_per_key

BUCKETS = 64

LOG_SCHEMA = StructType(
    [
        StructField("id", StringType()),
        StructField("seq", LongType()),
        StructField("kind", StringType()),
        StructField("tags", ArrayType(StringType())),
        StructField("seo_enabled", BooleanType()),
        StructField("metadata", StringType()),
        StructField("tombstone_at", TimestampType()),
        StructField("reason", StringType()),
    ]
)


class DocumentLog:
    """The tables ``<name>_base_<version>`` and ``<name>_log_<version>`` of the
    session's catalog, stored below ``folder``."""

    def __init__(self, spark: SparkSession, name: str, folder: str, *, buckets: int = BUCKETS, version: int = 0):
        self.spark, self.name, self.folder, self.buckets, self.version = spark, name, folder, buckets, version

    def _table(self, kind: str) -> str:
        return f"{self.name}_{kind}_{self.version}"

    def _write(self, rows: DataFrame, kind: str, mode: str) -> None:
        # one file per bucket and write, not one per bucket and task
        placed = rows.repartition(self.buckets, "id")
        writer = placed.write.format("parquet").mode(mode).bucketBy(self.buckets, "id").sortBy("id")
        writer.option("path", f"{self.folder}/{kind}-{self.version}").saveAsTable(self._table(kind))

    def create(self, documents: DataFrame) -> DocumentLog:
        """Write ``documents`` as the base, with an empty log."""
        self._write(documents, "base", "errorifexists")
        self._write(self.spark.createDataFrame([], LOG_SCHEMA), "log", "errorifexists")
        return self

    def base(self) -> DataFrame:
        return self.spark.table(self._table("base"))

    def log(self) -> DataFrame:
        return self.spark.table(self._table("log"))

    # ------------------------------------------------------------ changes
    def _append(self, rows: DataFrame, kind: str, seq: int) -> None:
        full = rows.withColumn("kind", F.lit(kind)).withColumn("seq", F.lit(seq).cast("long"))
        for f in LOG_SCHEMA.fields:
            if f.name not in full.columns:
                full = full.withColumn(f.name, F.lit(None).cast(f.dataType))
        self._write(full.select(*[F.col(f.name).cast(f.dataType) for f in LOG_SCHEMA.fields]), "log", "append")

    def replace_tags(self, changes: DataFrame, *, seq: int, trigger_tags=(), period_days: int = 90, as_of, order: str | None = None) -> None:
        """New tags; a trigger tag among them also sets the tombstone."""
        trigger = first_trigger_tag("tags", list(trigger_tags))
        rows = one_per_key(changes, "id", ["tags"], order).select(
            "id", "tags",
            F.when(trigger.isNotNull(), _days_after(as_of, period_days)).alias("tombstone_at"),
            F.concat(F.lit("auto-tombstone: "), trigger, F.lit(" tag")).alias("reason"),
        )
        self._append(rows, "tags", seq)

    def set_metadata(self, changes: DataFrame, *, seq: int, order: str | None = None) -> None:
        """A new metadata document (null: ``{}``)."""
        text = F.coalesce("metadata", F.lit("{}"))
        rows = one_per_key(changes, "id", ["metadata"], order).select("id", text.alias("metadata"), tombstone_at(text).alias("tombstone_at"))
        self._append(rows, "metadata", seq)

    def set_seo(self, changes: DataFrame, *, seq: int, order: str | None = None) -> None:
        """R63."""
        self._append(one_per_key(changes, "id", ["seo_enabled"], order), "seo", seq)

    def tombstone(self, ids: DataFrame, *, seq: int, period_days: int = 90, as_of) -> None:
        """A tombstone without a reason of its own."""
        self._append(ids.select("id").distinct().withColumn("tombstone_at", _days_after(as_of, period_days)), "tombstone", seq)

    def untombstone(self, ids: DataFrame, *, seq: int) -> None:
        """R64 undo: the instant goes, the reason stays."""
        self._append(ids.select("id").distinct(), "untombstone", seq)

    def delete(self, ids: DataFrame, *, seq: int) -> None:
        """R34 (the documents; jobs pointing at them are ``delete_documents``')."""
        self._append(ids.select("id").distinct(), "delete", seq)

    # ------------------------------------------------------------ reading
    def folded(self) -> DataFrame:
        """One row per changed id: each field's last change as a struct (null: none).
        Grouped by the log's own buckets, so nothing is shuffled."""
        kind = F.col("kind")
        triggered = (kind == "tags") & F.col("reason").isNotNull()

        def last(condition: Column, *cols: str) -> Column:
            return F.max_by(F.struct(*cols), F.when(condition, F.col("seq")))

        return self.log().groupBy("id").agg(
            last(kind == "tags", "tags").alias("c_tags"),
            last(kind == "seo", "seo_enabled").alias("c_seo"),
            last(kind == "metadata", "metadata", "seq").alias("c_meta"),
            last(triggered | kind.isin("tombstone", "untombstone", "metadata"), "tombstone_at", "kind").alias("c_tomb"),
            last(triggered, "reason", "seq").alias("c_reason"),
            F.max(kind == "delete").alias("c_gone"),
        )

    def read(self) -> DataFrame:
        """The documents as all changes leave them."""
        base = self.base()
        joined = base.join(self.folded(), "id", "left").filter(~F.coalesce("c_gone", F.lit(False)))
        hit = lambda c: F.col(c).isNotNull()
        # a tombstone change that came with the metadata document is in it already
        timed = hit("c_tomb") & (F.col("c_tomb.kind") != "metadata")
        # a reason given before the metadata document went with the old one
        reasoned = hit("c_reason") & (F.col("c_reason.seq") > F.coalesce(F.col("c_meta.seq"), F.lit(-(1 << 62))))
        text = F.when(hit("c_meta"), F.col("c_meta.metadata")).otherwise(F.col("metadata"))
        at = F.col("c_tomb.tombstone_at")
        entries = F.map_concat(
            M.meta_map(text),
            M.maybe_entry(timed & at.isNotNull(), "tombstone_datetime", M.vtext(rfc3339(at))),
            M.maybe_entry(reasoned, "tombstone_reason", M.vtext(F.col("c_reason.reason"))),
        )
        dropped = F.when(timed & at.isNull(), M.drop_key(entries, "tombstone_datetime")).otherwise(entries)
        return joined.select(
            *[
                {
                    "tags": F.when(hit("c_tags"), F.col("c_tags.tags")).otherwise(F.col("tags")),
                    "seo_enabled": F.when(hit("c_seo"), F.col("c_seo.seo_enabled")).otherwise(F.col("seo_enabled")),
                    "metadata": F.when(timed | reasoned, M.to_text(dropped)).otherwise(text),
                    "tombstone_at": F.when(hit("c_tomb"), at).otherwise(F.col("tombstone_at")),
                }.get(c, F.col(c)).alias(c)
                for c in base.columns
            ]
        )

    def missing(self) -> DataFrame:
        """Ids of the log that the base does not have: "not found"."""
        return self.log().select("id").join(self.base().select("id"), "id", "left_anti").distinct()

    def compact(self) -> DocumentLog:
        """What ``read`` gives as the base of the next version, with an empty log.
        The old tables stay until the caller drops them, so readers can finish."""
        after = DocumentLog(self.spark, self.name, self.folder, buckets=self.buckets, version=self.version + 1)
        return after.create(self.read())

    def drop(self) -> None:
        """Forget this version's tables; their files stay where they are."""
        for kind in ("base", "log"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(kind)}")
