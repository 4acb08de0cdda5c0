"""Exact deduplication against a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by digest, one row per distinct text ever seen. A batch is reduced to one row per
digest, compared with the index by a sort-merge anti-join, and what is new is appended. What is not new goes to a second table
of the same buckets: number and best row of the repetitions, so that a longer text that arrives later becomes the keeper.
``resolve`` names keeper and group size over all batches; both tables are joined without a shuffle.

Texts are equal when they are identical after every blank (space and the five ASCII control blanks) is deleted; null counts
as empty. The row with the most code points in its original text stays, then the one with the smallest id; a null id comes
after every other id. Rows that repeat both id and text are one row kept and the rest dropped, in whichever batches they come.
An empty batch appends nothing. Columns other than id and text are ignored, whatever their names.

A text held by a third of all rows is one row per map task before it is shuffled, and on the way back its group is found by
a broadcast of the few largest groups (see ``HOT_GROUPS``), so no task receives all its rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import quoted, shared_path, written

#: groups of more than 1/HOT_GROUPS of all rows are broadcast; there can be no more than HOT_GROUPS of them
HOT_GROUPS = 10_000
#: smaller groups never need it
HOT_ROWS = 1_000
#: buckets of the index of one job: so many rows of its documents each, and so many at least
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 16

_SPAN = "36893488147419103232"  # 2^65: more than there are ids
_TOP = "9223372036854775808"  # 2^63


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (32 bytes) and chars of the original text, for every row."""
    return docs.select(
        quoted(doc_id).cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(quoted(text)), 256)).alias("digest"),
        F.coalesce(F.char_length(quoted(text)), F.lit(0)).cast("long").alias("chars"),
    )


def _rank() -> Column:
    """One number that orders the rows of a group: more code points first, then the smaller id, null ids last.

    A decimal of fixed width lets Spark aggregate by hash, which a struct would not."""
    ident = F.lit(_TOP).cast("decimal(20,0)") - F.col("doc_id").cast("decimal(20,0)")
    length = F.col("chars").cast("decimal(12,0)") * F.lit(_SPAN).cast("decimal(20,0)")
    return (length + F.coalesce(ident, F.lit(0))).cast("decimal(38,0)")


def _rank_id(rank: Column) -> Column:
    ident = (rank % F.lit(_SPAN).cast("decimal(38,0)")).cast("decimal(20,0)")
    return F.when(ident > 0, (F.lit(_TOP).cast("decimal(20,0)") - ident).cast("long"))


def winners(batch: DataFrame) -> DataFrame:
    """One row per digest of a batch of digests: best rank and number of rows."""
    return batch.groupBy("digest").agg(F.max(_rank()).alias("rank"), F.count("*").alias("group_size"))


class DigestIndex:
    """The persistent tables of digests seen so far: digest, best rank and number of rows, of the batch that brought the digest
    and, in the table of repetitions, of every later batch."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    @classmethod
    def temporary(cls, spark: SparkSession, buckets: int = 64) -> DigestIndex:
        """An index with a name of its own in the shared folder, for one job; ``drop`` it in the end."""
        return cls(spark, f"digest_index_{uuid.uuid4().hex}", shared_path(spark, "digest-index"), buckets)

    def read(self, repeats: bool = False) -> DataFrame:
        name, path = self._table(repeats)
        self.spark.sql(f"""
            CREATE TABLE IF NOT EXISTS {name} (digest BINARY, rank DECIMAL(38,0), group_size BIGINT) USING parquet
            CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'""")
        return self.spark.table(name)

    def _table(self, repeats: bool) -> tuple[str, str]:
        return (f"{self.name}_repeats", f"{self.path}-repeats") if repeats else (self.name, self.path)

    def unseen(self, won: DataFrame, how: str = "left_anti") -> DataFrame:
        """Of the winners of a batch, those whose digest the index does not hold yet."""
        return won.join(self.read().select("digest").hint("merge"), "digest", how)

    def append(self, rows: DataFrame, repeats: bool = False) -> None:
        """Append winners; files are bucketed and sorted by digest, so later joins read them without a shuffle."""
        name, path = self._table(repeats)
        (rows.select("digest", "rank", "group_size").repartition(self.buckets, "digest")
         .write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append")
         .option("path", path).saveAsTable(name))

    def add(self, batch: DataFrame) -> None:
        """Take a batch of digests in."""
        won = written(winners(batch), "winners")
        # an empty index knows no repetitions
        again = None if self.read().isEmpty() else written(self.unseen(won, "left_semi"), "again")
        self.append(written(self.unseen(won), "fresh"))
        if again is not None:
            self.append(again, repeats=True)

    def keepers(self) -> DataFrame:
        """digest, keep_rank and group_size over all batches."""
        later = self.read(repeats=True).groupBy("digest").agg(F.max("rank").alias("later"), F.sum("group_size").alias("more"))
        return self.read().join(later.hint("merge"), "digest", "left").select(
            "digest", F.greatest("rank", "later").alias("keep_rank"), (F.col("group_size") + F.coalesce("more", F.lit(0))).alias("group_size"))

    def resolve(self, batch: DataFrame) -> DataFrame:
        """doc_id, keep_id, group_size, kept and digest for every row of ``batch`` (digests), as the index stands now."""
        return marked(batch, self.keepers())

    def ingest(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Take a batch of documents in and return its rows as ``resolve`` does. A later batch may bring a longer text of the
        same group: then ``resolve`` gives another keeper."""
        batch = written(digests(docs, doc_id, text), "digests")
        self.add(batch)
        return self.resolve(batch)

    def drop(self) -> None:
        """Forget the tables; their files stay in the folder they were given."""
        for repeats in (False, True):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(repeats)[0]}")


def marked(batch: DataFrame, keepers: DataFrame) -> DataFrame:
    """Every row of the batch with the keeper of its text; kept is the keeper itself, once."""
    # repeated rows meet here; their number returns by explode
    rows = batch.groupBy("digest", "doc_id", "chars").agg(F.count("*").alias("copies")).withColumn("rank", _rank())
    hot_rows = max(HOT_ROWS, (keepers.agg(F.sum("group_size").alias("n")).first()["n"] or 0) // HOT_GROUPS)
    # at most HOT_GROUPS rows of about 60 bytes
    hot = F.broadcast(keepers.filter(F.col("group_size") > hot_rows))
    by_hot = rows.join(hot, "digest")
    by_key = rows.join(hot.select("digest"), "digest", "left_anti").join(keepers, "digest")
    both = by_hot.select(*by_key.columns).unionByName(by_key)
    copies = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return copies.select(
        "doc_id", _rank_id(F.col("keep_rank")).alias("keep_id"), "group_size",
        ((F.col("copy") == 1) & (F.col("rank") == F.col("keep_rank"))).alias("kept"), "digest",
    )


def deduplicated(docs: DataFrame, batches: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest for every row of ``docs``, which go through a new index in ``batches``
    parts, dealt by id; the index is dropped."""
    every = written(digests(docs, doc_id, text), "digests")
    index = DigestIndex.temporary(docs.sparkSession, max(LEAST_BUCKETS, every.count() // BUCKET_ROWS))
    for number in range(batches):
        index.add(every.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == number))
    out = written(index.resolve(every), "deduplicated")
    index.drop()
    return out
