"""Exact deduplication against a persistent digest index.

The index lies in the shared folder, bucketed and sorted by SHA-256 digest. A batch is first brought down to one row for each digest (partial
aggregation before the shuffle, so a text with any number of copies costs one row per task), then deduplicated against the index by a sort-merge
anti-join that reads the buckets as they lie, and what is new is appended. DataFrame functions only.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, deleted, file_names, fresh, new_path, saved, spread_join, table, text_of, touched


class DigestIndex:
    """A digest index: for each batch and digest that it had, which row stayed, if one did, and how many copies there were.

    ``path`` is its folder; a folder that holds an index is opened as it is, whatever the catalog knows of it, and never written but by ``add``.
    ``buckets`` is fixed when the index is made: about one for each 128 MB that it will grow to. Without a path the index is a new one in the shared
    folder. ``_batches`` in its folder says which batches began and which are whole; rows of others don't count. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, name: str | None = None, buckets: int = 64):
        self.spark = spark
        self.path = path or new_path(spark, "digest-index")
        self.name = name or f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}"
        made = [n for n in file_names(spark, f"{self.path}/_index") if n.startswith("buckets-")]
        self.buckets = int(made[0].split("-")[1]) if made else buckets
        if not made:
            touched(spark, f"{self.path}/_index/buckets-{buckets}")
        if spark.catalog.tableExists(self.name):
            at = spark.sql(f"DESCRIBE FORMATTED {self.name}").filter("col_name = 'Location'").first()["data_type"]
            if at.rstrip("/").split(":", 1)[-1].lstrip("/") != self._rows.rstrip("/").split(":", 1)[-1].lstrip("/"):
                raise ValueError(f"table {self.name} lies in {at}, not in {self._rows}")
        else:
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, batch BIGINT, keep_id BIGINT, copies BIGINT, stayed BOOLEAN) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._rows}'"
            )

    @property
    def _rows(self) -> str:
        return f"{self.path}/rows"

    def _batches(self) -> tuple[dict[str, int], list[int], int]:
        """Whole batches' numbers by the hash of their ids; the numbers of others; the last number."""
        names = [n.split("-") for n in file_names(self.spark, f"{self.path}/_batches")]
        whole = {key: int(number) for number, key, state in names if state == "whole"}
        begun = {int(number) for number, _, _ in names}
        return whole, sorted(begun - set(whole.values())), max(begun, default=0)

    def _before(self, number: int, broken: list[int]) -> DataFrame:
        """One row for each digest of the whole batches before that number: digest, known_id (of the row that stayed), known_copies."""
        rows = self.spark.table(self.name).filter(F.col("batch") < number)
        if broken:
            rows = rows.filter(~F.col("batch").isin(broken))
        return rows.groupBy("digest").agg(F.max(F.when(F.col("stayed"), F.col("keep_id"))).alias("known_id"), F.sum("copies").alias("known_copies"))

    def frame(self) -> DataFrame:
        """digest, keep_id, group_size of all that the index has."""
        _, broken, last = self._batches()
        return self._before(last + 1, broken).select("digest", F.col("known_id").alias("keep_id"), F.col("known_copies").alias("group_size"))

    def close(self, delete: bool = False) -> None:
        """Takes the index out of the catalog; with ``delete``, out of the shared folder too."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if delete:
            deleted(self.spark, [self.path])

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, batch_id: str | None = None) -> DataFrame:
        """Deduplicates a batch, appends its digests, and returns one row for each row of the batch.

        Columns: row_id, doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when they are identical without ASCII white space;
        null counts as empty. Of equal texts in a batch the one with the most code points stays, then the smallest id; a null id comes last, and of
        repeated rows (same id, same length) one stays. Ids are whole numbers of 64 bits. A text that an earlier batch had is dropped whole: keep_id is
        then the id that stayed in that batch, and group_size counts the copies of this batch and all before it. An empty batch gives no rows. Other
        columns, of whatever names, are not read. ``row_col`` names a column of unique row ids if there is one; else rows are numbered here.

        A batch that failed can be added again under the same ``batch_id``, and one that is in the index already gets the same rows as before and
        isn't counted twice. Without an id each call is a batch of its own.
        """
        key = hashlib.md5((batch_id or uuid.uuid4().hex).encode()).hexdigest()
        whole, broken, last = self._batches()
        number = whole.get(key, last + 1)
        row = F.col(row_col) if row_col else F.monotonically_increasing_id()
        text = text_of(text_col)
        keyed = saved(
            docs.select(
                row.alias("row_id"), F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(F.sha2(F.translate(text, WHITE, "").cast("binary"), 256)).alias("digest"), F.char_length(text).cast("bigint").alias("n_chars")
            ),
            "digests",
        )
        best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"))
        groups = saved(keyed.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("copies")), "digest-groups")
        before = self._before(number, broken)
        own = groups.join(before.hint("merge"), "digest", "left_anti").select("digest", "copies", F.col("best.doc_id").alias("keep_id"), F.col("copies").alias("group_size"), F.col("best.row_id").alias("keep_row"), F.lit(True).alias("stayed"))
        known = groups.join(before.hint("merge"), "digest").select(
            "digest", "copies", F.col("known_id").alias("keep_id"), (F.col("copies") + F.col("known_copies")).alias("group_size"), F.lit(None).cast("bigint").alias("keep_row"), F.lit(False).alias("stayed")
        )
        found = saved(own.unionByName(known), "digest-decisions")
        if key not in whole:
            touched(self.spark, f"{self.path}/_batches/{number}-{key}-begun")
            rows = found.select("digest", F.lit(number).cast("bigint").alias("batch"), "keep_id", "copies", "stayed")
            rows.repartition(self.buckets, "digest").write.insertInto(self.name)
            touched(self.spark, f"{self.path}/_batches/{number}-{key}-whole")
        out = spread_join(keyed, found.drop("stayed"), ["digest"], "copies")
        return out.select("row_id", "doc_id", "keep_id", "group_size", F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, index: DigestIndex | None = None, batch_id: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns only. Without an index, one for this call alone."""
    row = fresh(docs.columns, "row_id")
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", "zstd")
    stay = (index.add(numbered, row_col=row, batch_id=batch_id) if index else _alone(numbered, row)).filter("kept").select(F.col("row_id").alias(row))
    return numbered.join(stay, row, "left_semi").select(*docs.columns)


def _alone(docs: DataFrame, row_col: str | None = None, delete: bool = True) -> DataFrame:
    """All rows as one batch against a new index, which goes when that is done, or stays in the shared folder."""
    index = DigestIndex(docs.sparkSession)
    out = index.add(docs, row_col=row_col)
    index.close(delete)
    return out


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one batch against a new index."""
    return _alone(table(spark, sf_dir, "documents"), delete=False).drop("row_id")


ORACLE = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""
