"""Quality jobs over field tables: rescoring, cross checks, block matches, merging of extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyr.functions import fields as P
from papyr.functions.text import trim_all


#: Fields that end and start a term, in the order in which they count, and those that must add up (fixed values).
ENDS, STARTS, SUMS = ("deadline", "payment_due_date", "expiry_date"), ("issue_date", "invoice_date", "date"), ("subtotal", "tax_amount", "total_amount")


def _with_band(rows: DataFrame, confidence: Column) -> DataFrame:
    rows = rows.withColumn("confidence", F.round(confidence, 9))
    return rows.withColumn("confidence_level", P.confidence_band(F.col("confidence")))


def validate_fields(fields: DataFrame) -> DataFrame:
    """Rescore the fields that aren't rejected by what their type demands; adds parsed_date, amount, normalized_value."""
    return validated(fields.where("not is_rejected"))


def validated(fields: DataFrame) -> DataFrame:
    """The same with rejected fields left in, as they are and without values of their own.

    Only a value that looks like a tax number is held to that form.
    """
    raw, c, open_one = F.col("raw_value"), F.col("confidence"), ~F.col("is_rejected")
    is_id = (F.col("field_type") == "ID_NUMBER") | F.contains("field_name", F.lit("gstin"))
    by_type = {"parsed_date": ("DATE", P.parse_date), "amount": ("CURRENCY", P.parse_amount)}
    rows = fields.withColumns({c: parse(F.when(open_one & (F.col("field_type") == t), raw)) for c, (t, parse) in by_type.items()})
    by_date = F.when(F.col("parsed_date").isNull(), F.least(c, F.lit(0.40))).otherwise(c)
    by_amount = (
        F.when(F.col("amount").isNull(), F.least(c, F.lit(0.40))).when(F.col("amount") < 0, F.greatest(F.lit(0.1), c - 0.25))
        .when(F.col("amount") > 100_000_000, F.least(c, F.lit(0.60))).otherwise(c)
    )
    valid = P.looks_like_gstin(raw) & P.is_gstin(raw)
    by_id = F.when(valid, F.least(F.lit(1.0), c + 0.1)).when(P.looks_like_gstin(raw), F.least(c, F.lit(0.30))).otherwise(c)
    scored = F.when(F.col("field_type") == "DATE", by_date).when(F.col("field_type") == "CURRENCY", by_amount).when(is_id, by_id).otherwise(c)
    normal = (
        F.when(F.col("field_type") == "DATE", F.col("parsed_date").cast("string"))
        .when(F.col("field_type") == "CURRENCY", F.col("amount").cast("decimal(20,2)").cast("string")).when(open_one & is_id & valid, F.upper(trim_all(raw)))
    )
    return _with_band(rows.withColumn("normalized_value", normal), F.when(open_one, P.clamp(scored)).otherwise(c))


def _named(column: str, name: str) -> Column:
    return F.max(F.when(F.col("field_name") == name, F.col(column))).alias(name)


def chronology_conflicts(validated: DataFrame) -> DataFrame:
    """document_id, target: the end date's field of documents whose end date is before the issue date."""
    wide = validated.groupBy("document_id").agg(*(_named("parsed_date", n) for n in ENDS + STARTS))
    target = F.coalesce(*(F.when(F.col(n).isNotNull(), F.lit(n)) for n in ENDS))
    late = wide.where(F.coalesce(*map(F.col, ENDS)) < F.coalesce(*map(F.col, STARTS)))
    return late.select("document_id", target.alias("target"))


def invoice_conflicts(validated: DataFrame) -> DataFrame:
    """Documents whose subtotal and tax miss the total by over 5 % of it and over 5."""
    wide = validated.groupBy("document_id").agg(*(_named("amount", n) for n in SUMS))
    off = F.abs(F.col("subtotal") + F.col("tax_amount") - F.col("total_amount"))
    return wide.where((off > F.col("total_amount") * 0.05) & (off > 5)).select("document_id", "subtotal", "tax_amount", "total_amount")


def cross_check(validated: DataFrame) -> DataFrame:
    """Lower the confidence of fields in conflict: end dates to 0.35, totals and taxes to 0.45.

    The dates and amounts of a document are gathered over its own rows: one shuffle, by document.
    """
    of = Window.partitionBy("document_id")
    named = lambda column, name: F.max(F.when(F.col("field_name") == name, F.col(column))).over(of)
    dates = {n: named("parsed_date", n) for n in ENDS + STARTS}
    amounts = {n: named("amount", n) for n in SUMS}
    rows = validated.withColumns({f"_{n}": v for n, v in (dates | amounts).items()})
    end, start = (F.coalesce(*(F.col(f"_{n}") for n in names)) for names in (ENDS, STARTS))
    target = F.coalesce(*(F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n in ENDS))
    subtotal, tax, total = (F.col(f"_{n}") for n in SUMS)
    off = F.abs(subtotal + tax - total)
    late = (end < start) & (F.col("field_name") == target)
    wrong = (off > total * 0.05) & (off > 5) & F.col("field_name").isin("total_amount", "tax_amount")
    set_to = F.when(late, F.lit(0.35)).when(wrong, F.lit(0.45)).otherwise(F.col("confidence"))
    return _with_band(rows, set_to).drop(*(f"_{n}" for n in dates | amounts))


def _matchable(rows: DataFrame, text: str) -> DataFrame:
    """``text`` trimmed and in small letters, of rows where that has three characters or more.

    It is exploded from an array of one: a filter over a plain column is moved below it and works the text out again.
    """
    return rows.withColumn(text, F.explode(F.array(F.lower(trim_all(text))))).where(F.length(text) >= 3)


def best_block_confidence(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, field_name, raw_value) and (version_id = document_id, block_text, confidence): the highest confidence
    of a block that holds the value or lies in it, both of three characters or more; fields without such block are left out."""
    f = _matchable(fields.select("document_id", "field_name", F.col("raw_value").alias("value")), "value")
    b = _matchable(blocks.select(F.col("version_id").alias("document_id"), F.col("block_text").alias("block"), F.col("confidence").alias("block_confidence")), "block")
    hits = f.join(b, "document_id").where(F.contains("block", F.col("value")) | F.contains("value", F.col("block")))
    return hits.groupBy("document_id", "field_name").agg(F.max("block_confidence").alias("best_block"))


def score_confidence(fields: DataFrame, best: DataFrame) -> DataFrame:
    """0.7 of the model's confidence and 0.3 of the best block's; the model's alone where no block matched."""
    return _mixed(fields.join(best, ["document_id", "field_name"], "left"))


def _mixed(rows: DataFrame) -> DataFrame:
    mixed = F.when(F.col("best_block").isNull(), F.col("confidence")).otherwise(0.7 * F.col("confidence") + 0.3 * F.col("best_block"))
    return _with_band(rows, P.clamp(mixed)).drop("best_block")


def conform_extractions(raw: DataFrame) -> DataFrame:
    """Trim names and values, drop blank ones, clamp the confidence (0.85 if missing), whole page numbers from 1."""
    rows = raw.withColumns({"field_name": trim_all("field_name"), "raw_value": trim_all("raw_value")}).where("field_name <> '' and raw_value <> ''")
    page = F.when(F.col("source_page") >= 1, F.floor("source_page")).otherwise(F.lit(1))
    return rows.withColumns({"confidence": P.clamp(F.coalesce("confidence", F.lit(0.85))), "source_page": page.cast("long"), "field_type": P.field_type(F.col("field_type"), F.col("field_name"))})


def merge_extractions(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Verified and rejected old fields stay and block new ones of their name; of the new, the first of a name counts.

    Blank new values are passed over. One shuffle, by document and name.
    """
    return _merged(old, new, order).select(*old.columns)


def _merged(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """The same with ``_first``, which tells the rows of a document and name apart."""
    preserved = old.where("is_verified or is_rejected").withColumn("_old", F.lit(True))
    fresh = new.where(trim_all("raw_value") != "").withColumns({"is_verified": F.lit(False), "is_rejected": F.lit(False), "_old": F.lit(False)})
    of = Window.partitionBy("document_id", "field_name")
    extra = [c for c in order if c not in preserved.columns]
    both = preserved.unionByName(fresh.select(*preserved.columns, *extra), allowMissingColumns=True)
    both = both.withColumns({"_blocked": F.max("_old").over(of), "_first": F.row_number().over(of.orderBy("_old", *order))})
    return both.where(F.col("_old") | (~F.col("_blocked") & (F.col("_first") == 1))).select(*old.columns, "_first")


def field_quality_pipeline(old: DataFrame, raw: DataFrame, blocks: DataFrame, order: list[str]) -> DataFrame:
    """New extractions through all steps: conform, merge with what people settled, score by blocks, validate, cross-check.

    Rejected fields stay in the table as they are, but for what a cross-check sets: it reaches every field of the
    document that has the name in question.

    The merged rows are made once: each meets the blocks of its document in one join, after which all is by document.
    """
    merged = _merged(old, conform_extractions(raw), order)
    rows = merged.withColumn("_value", F.when(~F.col("is_rejected"), F.lower(trim_all("raw_value"))))
    b = _matchable(blocks.select(F.col("version_id").alias("_document"), F.col("block_text").alias("_block"), F.col("confidence").alias("_confidence")), "_block")
    holds = (F.length("_value") >= 3) & (F.contains("_block", F.col("_value")) | F.contains("_value", F.col("_block")))
    scored = rows.join(b, (F.col("document_id") == F.col("_document")) & holds, "left").groupBy(*merged.columns).agg(F.max("_confidence").alias("_best"))
    best = F.when(~F.col("is_rejected"), F.max("_best").over(Window.partitionBy("document_id", "field_name")))
    return cross_check(validated(_mixed(scored.withColumn("best_block", best)))).drop("_best", "_first")
