"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

Everything is DataFrame work: a batch is reduced to one row per digest, meets the index in a
sort-merge anti-join (the index is not shuffled: its files are bucketed by digest), and what is
new is appended under the batch's name.

Defined results: a null text is an empty one; equal texts are those equal without blanks; of equal
texts the longest original stays, then the smallest id, null ids last, then the smallest hash of the original; rows
repeating an id and a text are one document and share its answer; texts of any length are digested whole; an empty
table gives an empty result; extra columns are ignored, whatever their names. A batch that is run again under its name
gets the same answers and adds nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists, fresh_path, store, write_once
from ..operators.joins import lookup_join
from .arrow_text import text_column
from .rows import keyed, one_of_each

BLANKS = r"[\x20\x09-\x0D]+"
# Small tables are replicated up to this payload.
REPLICATED = 1 << 20
# Digests of a bucket when an index is made or compacted, and buckets at least
BUCKET_DIGESTS, LEAST_BUCKETS = 2_000_000, 16
FORMAT = 1


class DigestIndex:
    """A table (digest, keep_id, batch) in ``path``, bucketed and sorted by digest.

    ``<path>/layouts/<n>`` says how edition n is kept (format, buckets, type of ids), ``<path>/edition=<n>`` holds
    it; the last layout counts. So whoever opens the path again finds the digests already there, with the buckets
    they were written in. An index gets its buckets from its first batch, and new ones when it is compacted.
    ``close`` takes it out of the session's catalogue; the files stay.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        """``buckets``: for an index that is made anew; one that exists keeps its own."""
        self.spark, self.path, self.id_type, self.wanted = spark, path, id_type, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self.edition, self.buckets = 0, None
        self._open()

    def _layouts(self) -> dict[int, dict]:
        """One short line for each edition."""
        if not exists(self.spark, f"{self.path}/layouts"):
            return {}
        found = [json.loads(r["value"]) for r in self.spark.read.text(f"{self.path}/layouts").collect()]
        return {x["edition"]: x for x in found}

    def _open(self) -> None:
        layouts = self._layouts()
        if not layouts:
            return
        layout = layouts[max(layouts)]
        if layout["format"] != FORMAT or layout["id_type"] != self.id_type:
            raise ValueError(f"the index at {self.path} is kept as {layout}, not with ids of type {self.id_type}")
        self.edition, self.buckets = layout["edition"], layout["buckets"]
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {self.id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._place(self.edition)}'"
        )

    def _place(self, edition: int) -> str:
        return f"{self.path}/edition={edition}"

    def _lay_out(self, edition: int, buckets: int) -> None:
        layout = {"edition": edition, "format": FORMAT, "buckets": buckets, "id_type": self.id_type}
        write_once(self.spark, f"{self.path}/layouts/{edition}", json.dumps(layout))
        self._open()

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def prepare(self, digests: DataFrame) -> None:
        """Lays an index out that has nothing yet, for a first batch of so many."""
        if not self.edition:
            self._lay_out(1, self.wanted or max(LEAST_BUCKETS, -(-digests.count() // BUCKET_DIGESTS)))

    def earlier(self, batch: str) -> DataFrame:
        """Digests that other batches brought."""
        return self.table().where(F.col("batch") != batch)

    def unknown(self, groups: DataFrame, batch: str) -> DataFrame:
        """Rows of ``groups`` (a row per digest) whose digest no other batch brought."""
        return groups.join(self.earlier(batch).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, fresh: DataFrame, batch: str) -> None:
        """Adds what a batch brings; what an earlier try of it has written already is not written again."""
        written = self.table().where(F.col("batch") == batch).select("digest").hint("merge")
        missing = fresh.select("digest", "keep_id").join(written, "digest", "left_anti").withColumn("batch", F.lit(batch))
        missing = store(missing, "missing")
        if not missing.isEmpty():
            self._write(missing, self.buckets).mode("append").saveAsTable(self.name)

    @staticmethod
    def _write(rows: DataFrame, buckets: int):
        dealt = rows.repartition(buckets, "digest").write.format("parquet")
        return dealt.bucketBy(buckets, "digest").sortBy("digest")

    def compact(self, buckets: int | None = None) -> None:
        """Writes a new edition with one file a bucket and as many buckets as its size asks for. Whoever has the old
        one open reads on; it is not deleted."""
        buckets = buckets or max(LEAST_BUCKETS, -(-self.table().count() // BUCKET_DIGESTS))
        edition, draft = self.edition + 1, f"digest_index_{uuid.uuid4().hex}"
        self._write(self.table(), buckets).option("path", self._place(edition)).saveAsTable(draft)
        self.spark.sql(f"DROP TABLE {draft}")
        self._lay_out(edition, buckets)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One slim row per document: keys, original length in code points, digest of the normalised text."""
    whole = text_column(docs, text)
    return keyed(docs, doc_id, text).select(
        "_row_id", "_row_hash", (-F.length(whole)).alias("_shorter"),
        F.unhex(F.sha2(F.regexp_replace(whole, BLANKS, "").cast("binary"), 256)).alias("digest"),
    )


def resolve(slim: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Brings the index up to date with a batch and returns a row per digest of the batch that has
    copies, in it or in the index: digest, keep_id, keep (the row that stays), group_size, seen (in the index before).

    Without a name a batch is a new one."""
    batch = batch or uuid.uuid4().hex
    rank = F.struct("_shorter", F.col("_row_id").isNull().alias("none"), F.col("_row_id").alias("keep_id"), "_row_hash")
    groups = slim.groupBy("digest").agg(F.min(rank).alias("keep"), F.count("*").alias("group_size"))
    groups = store(groups.select("digest", F.col("keep.keep_id").alias("keep_id"), "keep", "group_size"), "digests")
    index.prepare(groups)
    fresh = store(index.unknown(groups, batch), "fresh")
    old = groups.join(fresh.select("digest"), "digest", "left_anti").select("digest", "keep", "group_size")
    # read before the append, so that only other batches answer
    known = index.earlier(batch).select("digest", "keep_id").hint("merge")
    old = store(old.join(known, "digest").select("digest", "keep_id", "keep", "group_size"), "seen")
    index.append(fresh, batch)
    return fresh.where("group_size > 1").withColumn("seen", F.lit(False)).unionByName(old.withColumn("seen", F.lit(True)))


def dedup(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
    """A row per document, dropped ones too: doc_id, keep_id, group_size (in this batch), kept,
    text_sha256. Documents whose text the index had already are dropped in favour of its keep_id."""
    slim = store(digests(docs, doc_id, text), "slim")
    copies = store(resolve(slim, index, batch), "copies")
    alone = F.col("group_size").isNull()
    first = (
        F.col("_row_id").eqNullSafe(F.col("keep.keep_id")) & (F.col("_shorter") == F.col("keep._shorter"))
        & (F.col("_row_hash") == F.col("keep._row_hash"))
    )
    hot = max(256, slim.count() // 10_000)  # rows of a text, beyond which they are dealt out
    joined = lookup_join(slim, copies, ["digest"], ["_row_id", "_row_hash"], "left", limit=REPLICATED, hot_rows=hot)
    return joined.select(
        F.col("_row_id").alias("doc_id"),
        F.when(alone, F.col("_row_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (~F.col("seen") & first)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", index: DigestIndex | None = None,
              batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns; exactly one row for each distinct text.

    With an ``index``, texts it has leave as well, and the rest is appended to it.
    """
    slim = store(digests(docs, doc_id, text), "slim")
    gone = None
    if index is not None:
        seen = resolve(slim, index, batch).where("seen").select("digest")
        gone = slim.join(seen, "digest", "left_semi")
        slim = slim.join(seen, "digest", "left_anti")
    return one_of_each(docs, doc_id, text, slim, "digest", ["_shorter", "_row_id"], gone)


def temporary_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, fresh_path(spark, "digest-index"))
