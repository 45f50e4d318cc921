"""Streaming jobs: ingestion, request limits, answers from deltas, embedding once, audit, stuck versions.

Each takes a streaming DataFrame and gives one (or a started query); the registered batch queries are their twins.
"""

from __future__ import annotations

import datetime
import hashlib
import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from papyr.functions.text import script_language
from papyr.operators import platform
from papyr.operators.chunking import chunk_documents
from papyr.operators.retrieval import hash_embed_column

#: Folders that the versions of a batch are dealt over.
BUCKETS = 16
#: Times its limit that a version which waits no more is remembered, so that an older state doesn't begin the wait again.
KEPT_FOR = 10


def rate_windows(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(user_id, method, path, ts) -> requests in each fixed window of a user, method and path, with the limit that holds.

    A window is closed ``late`` after its end; requests later than that are left out. Null users form one user.
    """
    rows = platform.with_rate_rule(requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late))
    counted = rows.groupBy("user_id", "method", "path", "allowed", "span", F.window("ts", "15 minutes").alias("w"), "window_start").agg(F.count(F.lit(1)).alias("requests"))
    return platform.rate_verdicts(counted)


def audit_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Running counts of audit events by type and day."""
    return events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late).groupBy("event_type", F.window("created_at", "1 day").alias("day")).count()


def embed_once(texts: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """(model, text, seen_at): each text of a model once within the time to live."""
    keyed = texts.withColumn("content_key", F.sha2(F.concat_ws("\0", "model", "text"), 256))
    return keyed.withWatermark("seen_at", ttl).dropDuplicatesWithinWatermark(["content_key"])


def assemble_answers(deltas: DataFrame, patience: str = "1 hour") -> DataFrame:
    """(message_id, seq, delta, done) -> message_id, answer, complete: deltas joined in order of ``seq``.

    The last delta carries ``done``; a message is given out when all numbers up to it are there, whatever their order.
    Repeated deltas count once, also those that come after the message was given out: that is remembered until no delta
    has come for ``patience``. A message that gets none for so long before its end is given out as it is, not complete,
    and forgotten, so that the state doesn't grow with what never ends.
    """
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get[:2], strict=True)) if state.exists else {}
        given_out = state.exists and state.get[3]
        if state.hasTimedOut:
            state.remove()
            if given_out:
                return
            yield pd.DataFrame({"message_id": [key[0]], "answer": ["".join(held[i] for i in sorted(held))], "complete": [False]})
            return
        if given_out:
            state.setTimeoutDuration(wait)
            return
        last = state.get[2] if state.exists else -1
        for pdf in parts:
            held |= dict(zip(pdf["seq"], pdf["delta"].fillna(""), strict=True))
            last = max([last, *pdf.loc[pdf["done"], "seq"]])
        if last >= 0 and all(i in held for i in range(last + 1)):
            state.update(([], [], last, True))
            yield pd.DataFrame({"message_id": [key[0]], "answer": ["".join(held[i] for i in range(last + 1))], "complete": [True]})
        else:
            state.update((list(held), list(held.values()), last, False))
        state.setTimeoutDuration(wait)

    out = "message_id long, answer string, complete boolean"
    return deltas.groupBy("message_id").applyInPandasWithState(fold, out, "seqs array<long>, deltas array<string>, last long, given_out boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ingest(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Pages (version_id, page_number, raw_text) -> tables of pages, chunks and vectors under ``path``; see ``ingested``.

    A batch adds its pages to the page table and makes the chunks of every version that it touches anew, from all the
    version's pages so far: pages of a version can come in any number of batches, and a page that comes again replaces
    the earlier one. A batch writes folders of its own alone, so that one that runs again leaves the same rows, and
    nothing is overwritten that another batch wrote.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"{run}-{number}"
        landed = F.lit(datetime.datetime.now(datetime.UTC).isoformat()).cast("timestamp")

        def add(rows: DataFrame, table: str) -> None:
            marked = rows.withColumns({"batch": F.lit(name), "bucket": F.pmod(F.xxhash64("version_id"), F.lit(BUCKETS)).cast("int"), "landed": landed})
            marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(f"{path}/{table}")

        add(batch.select("version_id", "page_number", "raw_text"), "pages")
        everything = spark.read.parquet(f"{path}/pages")
        own = everything.where(F.col("batch") == name).select("version_id", "bucket").distinct()
        buckets = [r[0] for r in own.select("bucket").distinct().collect()]  # at most BUCKETS
        touched = everything.where(F.col("bucket").isin(buckets)).join(own.select("version_id"), "version_id", "left_semi")
        now = touched.groupBy("version_id", "page_number").agg(F.max_by("raw_text", F.struct("landed", "raw_text")).alias("raw_text"))
        now = now.withColumn("language", script_language(F.col("raw_text")))
        add(chunk_documents(now).withColumn("embedding", hash_embed_column(F.col("content"))), "chunks")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """The chunks, with vectors, of every version as of the last batch that touched it."""
    last = spark.read.parquet(f"{path}/pages").groupBy("version_id").agg(F.max("landed").alias("landed"))
    return spark.read.parquet(f"{path}/chunks").join(last, ["version_id", "landed"], "left_semi").drop("batch", "bucket", "landed")


def append_audit(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append audit rows to a table; a batch that can't be written is logged and passed over, the stream goes on.

    A batch has a folder of its own, named after the stream's checkpoint and its number, and replaces what is there: a
    batch that runs again, after it was written or half-way, leaves its rows once.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        try:
            batch.write.mode("overwrite").parquet(f"{path}/batch={run}-{number}")
        except Exception:  # what is audited must never wait for its audit
            logging.getLogger(__name__).exception("audit batch %s was not written", number)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audited(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an audit table."""
    return spark.read.parquet(path).drop("batch")


def stuck_versions(versions: DataFrame, now: str) -> DataFrame:
    """Versions that wait beyond the job timeout and their back-off as of ``now``, and whether to try again."""
    return platform.stuck_versions(versions, F.lit(now).cast("timestamp"))


def stuck_monitor(versions: DataFrame, timeout: float = platform.JOB_TIMEOUT, backoff: float = platform.BACKOFF, attempts: int = platform.ATTEMPTS) -> DataFrame:
    """A stream of (document_id, version_number, version_status, version_created_at, attempts) -> what to do with versions that wait too long.

    Each state of a version that is queued or in work sets a timer: ``timeout`` seconds and a back-off that doubles with
    each attempt, from when the state was reached. When it goes off the version is to be tried again (RETRY), which is
    one attempt more and sets the next timer, or has failed (FAIL) when it has had ``attempts``. Any other status ends
    the wait, for good if the same state comes again; of several states the newest counts. Timers are kept in the state
    and go on after a restart. The rows: document_id, version_number, attempts, action.
    """

    def watch(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        since, tried, waiting = state.get if state.exists else (-1, 0, False)
        if state.hasTimedOut:
            if not waiting:
                state.remove()
                return
            last = tried >= attempts
            yield pd.DataFrame({"document_id": [key[0]], "version_number": [key[1]], "attempts": [tried], "action": ["FAIL" if last else "RETRY"]})
            since, tried, waiting = (since, tried, False) if last else (now, tried + 1, True)
        else:
            for pdf in parts:
                for status, at, n in zip(pdf["version_status"], pdf["at"], pdf["attempts"], strict=True):
                    if (at, n) > (since, tried) or (at, n) == (since, tried) and status not in ("QUEUED", "PROCESSING"):
                        since, tried, waiting = int(at), int(n), status in ("QUEUED", "PROCESSING")
        state.update((since, tried, waiting))
        limit = 1000 * (timeout + backoff * 2**tried)
        state.setTimeoutDuration(max(int(since + limit - now), 1) if waiting else int(KEPT_FOR * limit))

    rows = versions.select("document_id", "version_number", "version_status", F.unix_millis(F.col("version_created_at").cast("timestamp")).alias("at"), F.coalesce("attempts", F.lit(0)).cast("int").alias("attempts"))
    out = "document_id long, version_number long, attempts int, action string"
    return rows.groupBy("document_id", "version_number").applyInPandasWithState(watch, out, "since long, tried int, waiting boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
