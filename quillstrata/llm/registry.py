"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.functions.text import fold_accents, uuid_key
from quillstrata.sources.tables import table


#: Trust of hosts that are not declared: the least.
LEAST_TRUST = 1_000_000


#: The record that gives an identifier says of which type it is: the surviving type must be that one.
P4_DEPENDENCIES = (("identifier_value", "identifier_type"),)


def p4_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, dict, list]:
    """The rows of the three tables with their groups, their bundles and the rank of donors: what ``survivors`` takes."""
    from quillstrata.llm.components import components
    from quillstrata.llm.survivors import counts_as_value, without_cut_mark
    from quillstrata.session import materialise

    hosts = table(spark, folder, "hosts").select("origin_host", "trust").dropDuplicates(["origin_host"])

    parts = []
    for tbl, at in (("projects", "updated_at"), ("concepts", "created_at")):
        name_key = F.nullif(F.regexp_replace(F.lower(fold_accents(F.col("name"))), r"[^\p{L}\p{N}]", ""), F.lit(""))
        none = F.lit(None).cast("string")
        parts.append(
            table(spark, folder, tbl).select(
                F.col("id").alias("row_id"), F.concat(F.lit(f"{tbl}|"), name_key).alias("grp"), "description", "origin_host",
                F.unix_micros(at).alias("at"), none.alias("identifier_type"), none.alias("identifier_value"), none.alias("written"),
            )
        )

    kind = F.regexp_replace(F.lower("identifier_type"), r"[^a-z0-9]", "")
    plain = F.regexp_replace(F.lower("identifier_value"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    bare = F.regexp_replace(plain, r"^(?:[a-z]+://[^/]*/(?:[a-z]+/)?|[a-z]+:\s*)", "")
    written = F.regexp_replace(bare, r"[^a-z0-9]", "")
    whole = counts_as_value(F.col("identifier_value")) & ~plain.rlike(r"(?:…|\.\.\.)$") & (kind != "")
    records = table(spark, folder, "concept_records").select(
        F.col("rec_no").alias("row_id"),
        F.coalesce(uuid_key(F.col("uuid")), F.lit("")).alias("u"),
        F.when(whole & (written != ""), F.concat(kind, F.lit("|"), written)).otherwise(F.lit("")).alias("i"),
        "description", "identifier_type", "identifier_value", written.alias("written"), "origin_host", "received_at",
    )
    # copies with the same two keys are one pair; a key's node is the least row that has it
    pairs = materialise(records.where("u <> '' OR i <> ''").groupBy("u", "i").agg(F.min("row_id").alias("m")), "pairs")
    by_uuid = pairs.where("u <> ''").groupBy("u").agg(F.min("m").alias("mu"))
    by_identifier = pairs.where("i <> ''").groupBy("i").agg(F.min("m").alias("mi"))
    noded = materialise(pairs.join(by_uuid, "u", "left").join(by_identifier, "i", "left").select("u", "i", F.coalesce("mu", "mi").alias("a"), F.coalesce("mi", "mu").alias("b")), "nodes")
    found = components(noded)
    placed = noded.join(found.withColumnRenamed("node", "a"), "a").select("u", "i", F.col("component").cast("string").alias("grp"))
    parts.append(
        records.join(placed, ["u", "i"], "left").select(
            "row_id", F.concat(F.lit("concept_records|"), F.col("grp")).alias("grp"), "description", "origin_host",
            F.unix_micros("received_at").alias("at"), "identifier_type", "identifier_value", "written",
        )
    )
    # one pipeline for the three tables; hosts are a fixed table of a dozen rows; latest first, no time last
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(hosts, "origin_host", "left")
    rank = [F.coalesce(F.col("trust").cast("long"), F.lit(LEAST_TRUST)), F.coalesce(-F.col("at"), F.lit(1 << 62))]
    # only a type that counts is said; a type that begins like another one is not cut off from it
    said = F.when(counts_as_value(F.col("identifier_type")), F.regexp_replace(F.lower("identifier_type"), r"[^a-z0-9]", ""))
    bundles = {
        "identifier_value": (F.col("identifier_value"), F.col("written"), {"value": F.col("identifier_value"), "with.identifier_type": said}),
        "identifier_type": (F.col("identifier_type"), F.concat(said, F.lit("|")), {"value": F.col("identifier_type"), "as": said}),
        "description": (F.col("description"), without_cut_mark(F.col("description")), {"value": F.col("description")}),
    }
    return rows, bundles, rank


def p4_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving record of each group, field by field with its donor."""
    from quillstrata.llm.survivors import survivors

    rows, bundles, rank = p4_rows(spark, folder)
    return survivors(rows, bundles, rank, P4_DEPENDENCIES).select(F.substring_index("grp", "|", 1).alias("tbl"), "group_id", "field", "row_id", "value")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Surviving descriptions and identifiers of the groups of projects, concepts and concept records."""
    return p4_survivors(spark, folder).where("field <> 'identifier_type'").drop("value")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of each document."""
    from quillstrata.llm.bpe import token_ids

    return token_ids(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the test items leaked into them."""
    from quillstrata.llm.leakage import leaked_items

    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are left once the affected ones are removed."""
    from quillstrata.llm.leakage import leaked_items, without_leaks

    documents = table(spark, folder, "documents")
    return without_leaks(documents, leaked_items(documents, table(spark, folder, "eval_items")))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    from quillstrata.llm.language import fit, language_segments

    documents = table(spark, folder, "documents")
    return language_segments(documents, fit(documents))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Right languages of documents with a missing or wrong label, and the stretches of mixed ones."""
    found = _segments(spark, folder)
    wrong = (F.col("seg_no") == 0) & ~F.col("lang").eqNullSafe(F.col("label"))
    # a document that mixes languages has at least two stretches: each one says so itself
    return found.where(wrong | (F.col("seg_no") > 0) & (F.col("segments") > 1)).select("doc_id", "seg_no", "lang")


def p9_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of every document (seg_no 0) and of each stretch."""
    return _segments(spark, folder).select("doc_id", "seg_no", "begin", "end", "lang", "confidence")


QUERIES = {"p4_found": p4_found, "p4_survivors": p4_survivors, "p7_ids": p7_ids, "p8_found": p8_found, "p8_clean": p8_clean, "p9_found": p9_found, "p9_segments": p9_segments}
ORACLES: dict[str, str] = {}
