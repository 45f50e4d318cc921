"""Jobs over documents, versions, reviews and requests: DataFrames in, a DataFrame out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyr.functions.fields import clamp, confidence_band
from papyr.functions.schemas import CATEGORIES, EXPECTED_FIELDS
from papyr.functions.text import let, trim_all
from papyr.operators.joins import holding

#: Milliseconds above which a stage is slow, or worth a warning (fixed values).
SLOW_MS, WARN_MS = 5000, 2000
#: Repair reasons in the order of the platform (fixed values).
REASONS = ("no-fields", "bad-category", "stale-embeddings", "no-chunks", "stuck")
#: Requests allowed in a window of so many seconds, by what the path holds and the method (fixed values).
RATE_RULES = (
    (("/auth/login",), None, 10, 900), (("/auth/register",), None, 10, 900), (("/documents",), "POST", 20, 60), (("/conversations", "/messages"), None, 40, 60), (("/search",), None, 80, 60), (("/review",), None, 150, 60),
)
DEFAULT_RULE = (150, 60)
#: Seconds that a job may take, and the first back-off, which doubles with each attempt; attempts in all (fixed values).
JOB_TIMEOUT, BACKOFF, ATTEMPTS = 600, 5, 3
#: Changes of a field between two versions, in the order in which they are shown (fixed values).
CHANGES = ("CHANGED", "ADDED", "REMOVED", "UNCHANGED")
#: Field names that one number holds as bits.
BITS = 62


def stage_timings(histories: DataFrame) -> DataFrame:
    """(document_id, stage_history JSON) -> stages that ended, their total and longest time, and the flag of the longest.

    A stage's time runs from the last start before an end to that end, in the order of the history; the last end
    counts, also where the stage was begun again after it. An end without a start before it is not timed. Histories
    without an ended stage give no row. All within the row: no shuffle.
    """
    runs = _stage_runs(F.from_json("stage_history", "array<struct<stage:string,status:string,at:bigint>>"))
    rows = histories.select("document_id", runs.alias("runs")).where(F.size("runs") > 0)
    ms = F.transform("runs", lambda r: r["ms"])
    sums = rows.select("document_id", F.size("runs").cast("long").alias("stages"), F.aggregate(ms, F.lit(0).cast("long"), lambda x, y: x + y).alias("total_ms"), F.array_max(ms).alias("slowest_ms"))
    return sums.withColumn("worst", F.when(F.col("slowest_ms") > SLOW_MS, "SLOW").when(F.col("slowest_ms") > WARN_MS, "WARN").otherwise("OK"))


def _stage_runs(marks: Column) -> Column:
    """Marks -> (stage, ms) of each stage's last end that has a start before it."""

    def of(all_marks: Column) -> Column:
        def run(end: Column, i: Column) -> Column:
            starts = F.filter(all_marks, lambda m, j: (j < i) & (m["stage"] == end["stage"]) & (m["status"] == "PROCESSING"))
            return F.when(end["status"] == "COMPLETED", F.struct(end["stage"].alias("stage"), (end["at"] - F.try_element_at(starts, F.lit(-1))["at"]).alias("ms")))

        return F.filter(F.transform(all_marks, run), lambda r: r["ms"].isNotNull())

    def last(runs: Column) -> Column:
        return F.filter(runs, lambda r, i: ~F.exists(F.slice(runs, i + 2, F.size(runs)), lambda later: later["stage"] == r["stage"]))

    return let(let(F.coalesce(marks, F.array().cast("array<struct<stage:string,status:string,at:bigint>>")), of), last)


def stage_time_quantiles(histories: DataFrame) -> DataFrame:
    """(document_id, stage_history) -> per stage the number of timed runs and the 50th, 90th and 99th percentile of them.

    The percentiles are exact, the times at rank ceil(n * p). Runs of one time are counted, by the tasks first, so that
    only counts are shuffled and put in order: no task holds the runs of a stage.
    """
    runs = _stage_runs(F.from_json("stage_history", "array<struct<stage:string,status:string,at:bigint>>"))
    counts = histories.select(F.inline(runs)).groupBy("stage", "ms").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("stage")
    upto = F.sum("n").over(of.orderBy("ms").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = counts.withColumns({"upto": upto, "runs": F.sum("n").over(of)})
    marks = (F.min(F.when(F.col("upto") * 100 >= F.col("runs") * p, F.col("ms"))).alias(f"p{p}_ms") for p in (50, 90, 99))
    return rows.groupBy("stage").agg(F.max("runs").alias("runs"), *marks)


def search_filters(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents of each request's user that meet its filters: category, language, document, first and last day.

    A null filter holds for every document; a document without the value meets no filter on it.
    """
    r, d = requests.alias("r"), docs.alias("d")
    met = [F.col(f"r.{a}").isNull() | F.coalesce(F.col(f"d.{b}") == F.col(f"r.{a}"), F.lit(False)) for a, b in (("category", "category"), ("language", "primary_language"), ("document_id", "document_id"))]
    met += [F.col("r.after").isNull() | (F.col("d.created_at") >= F.col("r.after")), F.col("r.before").isNull() | (F.col("d.created_at") <= F.col("r.before"))]
    on = F.col("d.user_id") == F.col("r.user_id")
    for m in met:
        on = on & m
    return d.join(r, on).select("r.query_id", "d.*")


def contains_any(rows: DataFrame, needles: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(query_id, needles: one for each column) -> (query_id, ``key``) of the rows that hold a needle in its column, whatever the case.

    ``key`` tells the rows apart. Null and empty needles match nothing. A needle meets the distinct values of its column
    that have its rarest three characters: no pair of row and query is looked at by itself, nothing has to be small.
    """
    found = []
    for i, c in enumerate(columns):
        low = rows.select(key, F.lower(c).alias("raw")).where("raw is not null")
        own = needles.select("query_id", F.lower(F.get("needles", F.lit(i))).alias("value"))
        held = holding(low.groupBy("raw").agg(F.count(F.lit(1)).alias("df")), own.select("value"))
        found.append(own.join(held, "value").join(low, "raw").select("query_id", key))
    return reduce(DataFrame.unionByName, found).distinct()


def list_documents(requests: DataFrame, docs: DataFrame, latest: DataFrame) -> DataFrame:
    """A page of each user's documents: filtered, ordered, with total, pages and latest version (0 for none)."""
    rows = docs.join(requests.withColumnRenamed("status", "want_status").withColumnRenamed("category", "want_category"), "user_id")
    rows = rows.where("(want_status is null or status = want_status) and (want_category is null or category = want_category)")
    rows = rows.where(F.col("search").isNull() | F.contains(F.lower("title"), F.lower("search")))
    keys = []
    for name in ("title", "created_at"):
        for desc in (True, False):
            value = F.when((F.col("sort_by") == name) & (F.col("descending") == desc), F.col(name))
            keys.append(value.desc() if desc else value.asc())
    of = Window.partitionBy("user_id")
    rows = rows.withColumns({"total": F.count(F.lit(1)).over(of), "n": F.row_number().over(of.orderBy(*keys, "document_id")).cast("long")})
    page = rows.where("n > (page - 1) * size and n <= page * size").join(latest, "document_id", "left")
    return page.select("user_id", "document_id", "title", F.coalesce("latest_version", F.lit(0)).alias("latest_version"), "n", "total", F.ceil(F.col("total") / F.col("size")).alias("total_pages"))


def audit_query(events: DataFrame, requests: DataFrame) -> DataFrame:
    """(actor_id, want_type, want_resource, after, before, most) -> each actor's newest events, at most 1 to 50."""
    rows = events.join(requests, "actor_id")
    rows = rows.where("(want_type is null or event_type = want_type) and (want_resource is null or resource_type = want_resource) and (after is null or created_at >= after) and (before is null or created_at <= before)")
    n = F.row_number().over(Window.partitionBy("actor_id").orderBy(F.desc("created_at"), "audit_id"))
    return rows.withColumn("n", n).where(F.col("n") <= F.greatest(F.lit(1), F.least(F.lit(50), F.col("most"))))


def field_pairs(fields: DataFrame) -> DataFrame:
    """Fields of versions -> document_id, version_number, ``old`` and ``new``: (name, value) of the version before and its own, in order.

    Each field goes to its own and to the next version, so one shuffle brings both together.
    """
    sides = F.array(F.struct(F.col("version_number").alias("v"), F.lit(True).alias("new")), F.struct((F.col("version_number") + 1).alias("v"), F.lit(False).alias("new")))
    rows = fields.withColumn("side", F.explode(sides)).where("side.v > 1 and side.v <= last_version")

    def own(new: bool) -> Column:
        listed = F.collect_list(F.when(F.col("side.new") == new, F.struct("seq", "name", "value")))
        return F.transform(F.sort_array(listed), lambda f: F.struct(f["name"], f["value"]))

    return rows.groupBy("document_id", F.col("side.v").alias("version_number")).agg(own(False).alias("old"), own(True).alias("new"))


def field_changes(old: Column, new: Column) -> Column:
    """Two lists of fields -> (no, field_name, old_value, new_value) of each name, by the change's place in ``CHANGES``, then by name.

    Of a name that comes twice in a list the last one counts.
    """

    def value(fields: Column, name: Column) -> Column:
        return F.try_element_at(F.filter(fields, lambda f: f["name"].eqNullSafe(name)), F.lit(-1))["value"]

    def numbered(f: Column) -> Column:
        same = trim_all(f["old_value"]) == trim_all(f["new_value"])
        change = F.when(f["old_value"].isNull(), "ADDED").when(f["new_value"].isNull(), "REMOVED").when(same, "UNCHANGED").otherwise("CHANGED")
        return F.struct(F.array_position(F.array(*map(F.lit, CHANGES)), change).alias("no"), f["field_name"].alias("field_name"), f["old_value"].alias("old_value"), f["new_value"].alias("new_value"))

    names = F.array_distinct(F.concat(old["name"], new["name"]))
    values = F.transform(names, lambda n: F.struct(n.alias("field_name"), value(old, n).alias("old_value"), value(new, n).alias("new_value")))
    return F.sort_array(F.transform(values, numbered))


def pairs_diff(pairs: DataFrame) -> DataFrame:
    """Rows of ``field_pairs`` -> document_id, version_number, field_name, old and new value, change, and the field's place. No shuffle."""
    rows = pairs.select("document_id", "version_number", F.posexplode(field_changes(F.col("old"), F.col("new"))).alias("at", "f"))
    change = F.element_at(F.array(*map(F.lit, CHANGES)), F.col("f.no").cast("int"))
    return rows.select("document_id", "version_number", "f.field_name", "f.old_value", "f.new_value", change.alias("change"), (F.col("at") + 1).cast("long").alias("place"))


def pairs_summary(pairs: DataFrame) -> DataFrame:
    """Rows of ``field_pairs`` -> document_id, version_number and the number of fields of each change. No shuffle."""
    rows = pairs.select("document_id", "version_number", field_changes(F.col("old"), F.col("new"))["no"].alias("no"))

    def counted(i: int) -> Column:
        return F.size(F.filter("no", lambda no: no == i)).cast("long")

    return rows.select("document_id", "version_number", *(counted(i).alias(c.lower()) for i, c in enumerate(CHANGES, 1)))


def version_field_diff(fields: DataFrame) -> DataFrame:
    """Fields of versions, one a row, against the version before: changed, added, removed, unchanged, by name within."""
    return pairs_diff(field_pairs(fields))


def apply_review_events(fields: DataFrame, events: DataFrame) -> DataFrame:
    """Reviewed fields after all events: any rejection stays, the last edit gives the value, all are verified.

    Accepting keeps the confidence, an edit sets it to 1; both make it HIGH. Fields without events are left out.
    """
    order = F.struct("created_at", "event_id")
    edited = F.when(F.col("action") == "EDITED", order)
    folded = events.groupBy("document_id", "field_name").agg(
        F.max(F.col("action") == "REJECTED").alias("rejected"), F.max(F.col("action") != "REJECTED").alias("good"), F.max_by("new_value", edited).alias("edit"), F.max(F.col("action") == "EDITED").alias("edited"),
    )
    rows = fields.join(folded, ["document_id", "field_name"])
    return rows.select(
        "document_id", "field_name", (F.col("is_rejected") | F.col("rejected")).alias("is_rejected"), F.lit(True).alias("is_verified"), F.when(F.col("edited"), F.trim("edit")).otherwise(F.col("raw_value")).alias("raw_value"),
        F.when(F.col("edited"), F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("good"), "HIGH").otherwise(confidence_band(F.col("confidence"))).alias("confidence_level"),
    )


def apply_category_overrides(docs: DataFrame, events: DataFrame) -> DataFrame:
    """(document_id, user_category, created_at, event_id) -> corrected documents: the last user's category, the model's first."""
    last = events.groupBy("document_id").agg(F.max_by("user_category", F.struct("created_at", "event_id")).alias("user_category"), F.count(F.lit(1)).alias("corrections"))
    rows = docs.join(last, "document_id")
    return rows.select("document_id", F.col("user_category").alias("category"), F.lit(True).alias("category_override"), F.coalesce("category", F.lit("UNKNOWN")).alias("ai_category"), "user_category", "corrections")


def needs_repair(inventory: DataFrame, model: str = "m1", reasons: tuple[str, ...] = REASONS, ids: list[int] | None = None) -> DataFrame:
    """The inventory's documents with ``reasons``; those with any of the chosen ones, or just the given ids."""
    stale = F.exists(F.filter(F.split("models", ","), lambda m: m != ""), lambda m: m != model)
    tests = (F.col("field_count") == 0, F.col("category").isin("-", "UNKNOWN"), stale, F.col("chunk_count") == 0, ~F.col("status").isin("COMPLETED", "FAILED"))
    found = F.filter(F.array(*(F.when(t, F.lit(r)) for r, t in zip(REASONS, tests, strict=True))), F.isnotnull)
    rows = inventory.withColumn("reasons", found)
    if ids is not None:
        return rows.where(F.col("document_id").isin(ids))
    return rows.where(F.arrays_overlap("reasons", F.array(*map(F.lit, reasons))))


def missing_sources(versions: DataFrame, listing: DataFrame) -> DataFrame:
    """Versions that can't be read, and why: no (or a pending) storage key, or a key that the listing doesn't have."""
    unset = F.col("storage_key").isNull() | (F.col("storage_key") == "PENDING")
    without = versions.where(unset).withColumn("why", F.lit("NO_STORAGE_KEY"))
    gone = versions.where(~unset).join(listing.select("storage_key"), "storage_key", "left_anti").withColumn("why", F.lit("MISSING_IN_STORAGE"))
    return without.unionByName(gone)


def apply_patch(rows: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with the patch's values where it has them; a null in the patch leaves the old value."""
    new = patch.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    return rows.join(new, key, "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in columns}).drop(*(f"new_{c}" for c in columns))


def soft_delete(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(document_id, at) -> documents with is_deleted and deleted_at; one that was deleted before keeps its state."""
    rows = docs.join(gone, "document_id", "left")
    return rows.withColumns({"deleted_at": F.when(~F.col("is_deleted"), F.col("at")), "is_deleted": F.col("is_deleted") | F.col("at").isNotNull()}).drop("at")


def delete_conversations(messages: DataFrame, citations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and citations without those of the conversations that go."""
    return tuple(t.join(gone.select("conversation_id"), "conversation_id", "left_anti") for t in (messages, citations))


#: What a retry empties, by who asks for it (fixed values).
CLEARED = {
    "user": ("processing_error", "processing_error_code", "processing_error_stack", "started_at", "completed_at", "processing_duration_ms"),
    "admin": ("processing_error", "processing_error_code", "started_at", "completed_at"),
}


def retry_reset(docs: DataFrame, versions: DataFrame, by_admin: bool) -> DataFrame:
    """Live documents (document_id, status) and versions -> the patches of a retry, one per document.

    versions: document_id, version_number, storage_key, stage_history, processing_stage, retry_count. Only the latest
    version counts, and only if it has a storage key. A user's retry takes a document whatever its status, begins again
    from the first stage with an empty history, and counts up; the admin's bulk retry takes failed and queued ones and
    leaves stage, history and count. The attempt is final when it is the last one allowed. One aggregate by document.
    """
    path = "admin" if by_admin else "user"
    newest = versions.groupBy("document_id").agg(F.max_by(F.struct("version_number", "storage_key", "stage_history", "processing_stage", "retry_count"), "version_number").alias("v"))
    rows = docs.where(F.col("status").isin("FAILED", "QUEUED")) if by_admin else docs
    rows = rows.join(newest, "document_id").select("document_id", "v.*").where("storage_key <> ''")
    count = F.col("retry_count") + (0 if by_admin else 1)
    return rows.select(
        "document_id", "version_number", F.lit(path).alias("path"), F.lit("QUEUED").alias("status"), F.lit("QUEUED").alias("processing_status"),
        (F.col("processing_stage") if by_admin else F.lit("FILE_VALIDATION")).alias("processing_stage"), (F.col("stage_history") if by_admin else F.lit("[]")).alias("stage_history"),
        count.alias("retry_count"), (count >= ATTEMPTS).alias("final_attempt"), F.lit(",".join(CLEARED[path])).alias("cleared"),
    )


def conform_category(rows: DataFrame, token: Callable[[Column], Column]) -> DataFrame:
    own = token(F.col("category"))
    return rows.select("document_id", F.when(own.isin(*CATEGORIES), own).otherwise("UNKNOWN").alias("category"), clamp(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def registry_sql() -> str:
    """The expected fields as a table of values."""
    values = ", ".join(f"('{c}', '{f}', '{t}')" for c, own in EXPECTED_FIELDS.items() for f, t in own.items())
    return f"SELECT * FROM (VALUES {values}) AS r(category, field_name, field_type)"


def schema_completeness(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Per document: its category in the registry (else UNKNOWN), how many fields that expects, and how many are there.

    The names that a document has are bits of a few numbers, so that a task holds one short row a document, not one a field.
    """
    names = sorted({f for own in EXPECTED_FIELDS.values() for f in own})
    parts = [{f: 1 << i for i, f in enumerate(names[at : at + BITS])} for at in range(0, len(names), BITS)]
    wanted = [(c, len(own), *(sum(bits.get(f, 0) for f in own) for bits in parts)) for c, own in EXPECTED_FIELDS.items()]
    registry = docs.sparkSession.createDataFrame(wanted, "category string, expected long, " + ", ".join(f"_want_{i} long" for i in range(len(parts))))
    known = F.when(F.col("category").isin(*EXPECTED_FIELDS), F.col("category")).otherwise("UNKNOWN")

    def bit(bits: dict[str, int]) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x).cast(k) for f, b in bits.items() for x, k in ((f, "string"), (b, "long")))), F.col("field_name")), F.lit(0).cast("long"))

    there = fields.where("not is_rejected").groupBy("document_id").agg(*(F.bit_or(bit(bits)).alias(f"_have_{i}") for i, bits in enumerate(parts)))
    counted = docs.select("document_id", known.alias("category")).join(F.broadcast(registry), "category").join(there, "document_id", "left")
    present = sum(F.bit_count(F.col(f"_have_{i}").bitwiseAND(F.col(f"_want_{i}"))).cast("long") for i in range(len(parts)))
    counted = counted.withColumn("present", F.coalesce(present, F.lit(0).cast("long")))
    return counted.select("document_id", "category", "expected", "present", F.round(F.col("present") / F.col("expected"), 6).alias("completeness"))


def with_rate_rule(requests: DataFrame) -> DataFrame:
    """(user_id, method, path, ts) -> with allowed, span and the start of the fixed window, in seconds."""
    rule = F.struct(*(F.lit(x).cast("long").alias(n) for x, n in zip(DEFAULT_RULE, ("allowed", "span"), strict=True)))
    for parts, method, allowed, span in reversed(RATE_RULES):
        fits = F.lit(True) if method is None else F.col("method") == method
        for part in parts:
            fits = fits & F.contains("path", F.lit(part))
        rule = F.when(fits, F.struct(F.lit(allowed).cast("long").alias("allowed"), F.lit(span).cast("long").alias("span"))).otherwise(rule)
    rows = requests.withColumn("rule", rule).select("*", "rule.*").drop("rule")
    return rows.withColumn("window_start", F.floor(F.unix_timestamp("ts") / F.col("span")) * F.col("span"))


def rate_verdicts(counted: DataFrame) -> DataFrame:
    return counted.select(
        "user_id", "method", "path", "window_start", "requests", (F.col("requests") > F.col("allowed")).alias("limited"), F.greatest(F.col("allowed") - F.col("requests"), F.lit(0)).alias("remaining"),
        (F.col("window_start") + F.col("span")).alias("reset_at"),
    )


def stuck_versions(versions: DataFrame, now: Column) -> DataFrame:
    """(version_status, version_created_at, attempts) -> versions still waiting beyond timeout and back-off, and what to do."""
    waited = F.unix_timestamp(now) - F.unix_timestamp("version_created_at")
    late = waited > JOB_TIMEOUT + BACKOFF * F.pow(F.lit(2.0), F.col("attempts"))
    rows = versions.where(F.col("version_status").isin("QUEUED", "PROCESSING") & late)
    return rows.withColumn("action", F.when(F.col("attempts") >= ATTEMPTS, "FAIL").otherwise("RETRY"))
