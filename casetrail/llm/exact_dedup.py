"""Exact duplicates by a stream whose keyed state never expires, with a check of full bytes on every hit.

The stream's state lives in RocksDB on the executors' disks and in the checkpoint in the shared folder. It keeps, per digest of a
normalised text, the stable identifier of the document that stays, the locator of its content (file and row) and the
number of documents seen. More documents can be ingested at any time, also by a later session: the state goes on, and the texts
of a call with a ``home`` stay there, so that a later one can compare bytes with them.

Digests alone do not decide. Of every digest that more than one document has, the bytes of all its texts are compared: the
least and the greatest text of a digest must be one. The two combine before the shuffle, so a group of a third of all
documents costs one row per task. Digests with different texts are told apart by the texts themselves.

Only DataFrame operations run on the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.llm.rows import SMALL_ROWS, anchored, col, join_counted, placed, unpacked, without
from casetrail.session import broadcast_if_small, shared_folder, stash

PLACE = "struct<no_id: boolean, doc_id: long, file: string, pos: long>"
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # each of many small stores would set aside megabytes for its log and its list of files
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def whole(sha: Column) -> Column:
    return sha


class Deduplicator:
    """The state of a stream of documents under ``home``, a folder all executors share.

    ``key`` takes the SHA-256 of a text to the key of the state. Any function gives right results; a short key only makes
    more work for the check of full bytes.
    """

    def __init__(self, spark: SparkSession, home: str | None = None, key: Callable[[Column], Column] = whole):
        self.spark = spark
        self.home = home or f"{shared_folder(spark)}/casetrail/exact-{uuid.uuid4().hex}"
        self.key = key

    def digests(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """``key``, ``sha`` (SHA-256 of the normalised text) and ``first`` (id and locator) of every document."""
        rows = placed(docs, doc_id=col(doc_id), body=normalised(col(text)))
        first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), "file", "pos")
        sha = F.unhex(F.sha2(F.col("body").cast("binary"), 256))
        return rows.select(self.key(sha).alias("key"), sha.alias("sha"), first.cast(PLACE).alias("first"))

    def ingest(self, narrow: DataFrame) -> None:
        """Take ``digests`` into the state. A batch that runs again after a failure replaces what it wrote."""
        inbox = f"{self.home}/inbox"
        self.kind = narrow.schema["key"].dataType.simpleString()
        narrow.select("key", "first").write.mode("append").parquet(inbox)
        arrived = self.spark.readStream.schema(narrow.select("key", "first").schema).parquet(inbox)
        held = arrived.groupBy("key").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))

        def keep(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{self.home}/state/batch={batch}")

        before = {name: self.spark.conf.get(name, None) for name in STORE}
        for name, value in STORE.items():
            self.spark.conf.set(name, value)
        try:
            (held.writeStream.outputMode("update").foreachBatch(keep)
             .option("checkpointLocation", f"{self.home}/checkpoint").trigger(availableNow=True).start().awaitTermination())
        finally:
            for name, value in before.items():
                self.spark.conf.unset(name) if value is None else self.spark.conf.set(name, value)

    def state(self) -> DataFrame:
        """``key``, ``first``, ``n``: the state of each key as the last batch that changed it left it."""
        last = F.max_by(F.struct("first", "n"), "batch").alias("last")
        rows = self.spark.read.option("basePath", f"{self.home}/state").parquet(f"{self.home}/state")
        return rows.groupBy("key").agg(last).select("key", "last.first", "last.n")

    def texts(self) -> DataFrame:
        """``key, body, first, n`` of the texts of earlier calls: each text once per call."""
        schema = f"key {self.kind}, body string, first {PLACE}, n long"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.home}/texts")
        except AnalysisException:  # the first call
            return self.spark.createDataFrame([], schema)

    def remember(self, now: DataFrame) -> None:
        """Keep a call's texts for later ones."""
        now.select("key", "body", "first", "n").write.mode("append").parquet(f"{self.home}/texts")


def _by_text(mixed: DataFrame) -> DataFrame:
    """``key, body, first, n``: the documents of each text. They combine before the shuffle."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "pos").cast(PLACE)
    return mixed.groupBy("key", "body").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))


def _over_sessions(held: Deduplicator, rows: DataFrame, state: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with ``first`` and ``n`` of their text, this call's documents and those of earlier ones counted.

    The state says which keys have been seen before. Their texts are read where the locator says, in the texts that earlier calls
    left under ``home``, and compared as a whole; a key alone decides nothing.
    """
    whole_rows = stash(rows.join(texts, ["file", "pos"]))
    now = stash(_by_text(whole_rows))
    seen = state.where("n > 1").select("key")
    before = held.texts().join(seen, "key", "left_semi").groupBy("key", "body").agg(
        F.min("first").alias("_first"), F.sum("n").alias("_n"))
    both = now.join(before, ["key", "body"], "left").select(
        "key", "body", F.least("first", "_first").alias("first"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
    found = stash(whole_rows.join(both, ["key", "body"]).select(*rows.columns, "first", "n"))
    held.remember(now)
    return found


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", home: str | None = None,
                     key: Callable[[Column], Column] = whole) -> DataFrame:
    """One row per document, dropped ones too: ``doc_id``, ``keep_id`` (the least id of the documents with an equal text),
    ``group_size``, ``kept``, ``text_sha256`` of the normalised text, and its place (``file``, ``pos``).

    Null texts count as empty. A null id counts as greater than any other; of rows with equal ids and texts the first by
    place is kept, so exactly one row of a group is. No documents give no rows. Other columns are not looked at. With the
    ``home`` of an earlier run its documents count too, and ``keep_id`` may be one of them.
    """
    spark, docs = docs.sparkSession, anchored(docs)
    held = Deduplicator(spark, home, key)
    narrow = stash(held.digests(docs, doc_id, text))
    held.ingest(narrow)
    state = stash(held.state())
    rows = narrow.select("key", "sha", "first.doc_id", "first.file", "first.pos")

    # hits: the bytes of all texts with one key
    shared = join_counted(rows, state.where("n > 1").select("key", "n"), "key", how="inner")
    members = broadcast_if_small(stash(shared.select("key", "file", "pos")), SMALL_ROWS)
    texts = placed(docs, body=normalised(col(text))).select("file", "pos", "body")
    if home is not None:
        met = _over_sessions(held, rows, state, texts)
    else:
        texts = texts.join(members, ["file", "pos"])
        clashes = stash(texts.groupBy("key").agg(F.min("body").alias("least"), F.max("body").alias("most"))
                        .where("least <> most").select("key"))

        met = join_counted(rows, state, "key", how="inner")
        if not clashes.isEmpty():
            # told apart by the text itself
            mixed = rows.join(texts.join(clashes, "key", "left_semi").drop("key"), ["file", "pos"])
            met = (met.join(clashes, "key", "left_anti")
                   .unionByName(mixed.join(_by_text(mixed), ["key", "body"]).select(*met.columns)))
    return met.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("first.file") == F.col("file")) & (F.col("first.pos") == F.col("pos"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "file", "pos")


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group of equal texts: the one with the least id."""
    docs = anchored(docs)
    found = stash(exact_duplicates(docs, doc_id, text))
    return unpacked(without(placed(docs), found.where("not kept")))
