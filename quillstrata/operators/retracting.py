"""The sweep for retracted citations, against a feed or with a checker of the caller's."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.operators.reading import unretracted_dois
from quillstrata.sources.store import Snapshot, completed

# Fixed value: the note of a retraction of which nothing more is known.
DEFAULT_NOTE = "Retracted (Retraction Watch)"

Checker = Callable[[str], tuple[bool, str]]


def retraction_note(reason: Column, date: Column) -> Column:
    """'Reason (Date)', the one of them there is, or the default."""
    r, d = F.coalesce(reason, F.lit("")), F.coalesce(date, F.lit(""))
    return F.when((r != "") & (d != ""), F.concat(r, F.lit(" ("), d, F.lit(")"))).when(r != "", r).when(d != "", d).otherwise(DEFAULT_NOTE)


def notes_from_feed(feed: DataFrame) -> DataFrame:
    """``feed(seq, doi, reason, retraction_date)`` to ``(doi, note)``: the first entry of each DOI counts."""
    return feed.groupBy("doi").agg(F.min_by(F.struct("reason", "retraction_date"), "seq").alias("f")).select("doi", retraction_note(F.col("f.reason"), F.col("f.retraction_date")).alias("note"))


def notes_from_checker(dois: DataFrame, check: Checker) -> DataFrame:
    """``check(doi)`` gives (hit, note); it runs on the executors, once per distinct DOI; an error counts as no hit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = []
            for doi in batch["doi"]:
                try:
                    hit, note = check(doi)
                except Exception:
                    continue
                if hit:
                    hits.append((doi, note))
            yield pd.DataFrame(hits, columns=["doi", "note"])

    return dois.select("doi").distinct().mapInPandas(run, "doi string, note string")


def http_checker(url: str, timeout: float = 30.0) -> Checker:
    """A checker that asks a service about one DOI: ``url?ArticleDOI=…``, of whose JSON list the first entry counts."""

    def check(doi: str) -> tuple[bool, str]:
        with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode({'ArticleDOI': doi})}", timeout=timeout) as answer:
            if answer.status != 200:
                raise OSError(f"status {answer.status}")
            entries = json.load(answer)
        if not entries:
            return False, ""
        reason, date = entries[0].get("Reason") or "", entries[0].get("RetractionDate") or ""
        return True, f"{reason} ({date})" if reason and date else reason or date or DEFAULT_NOTE

    return check


def sweep(s: Snapshot, notes: DataFrame, now: Column) -> tuple[Snapshot, DataFrame]:
    """Flags every hit among the DOIs not retracted yet; all that were looked at get ``now``. Also one row ``(checked, updated)``."""
    due = unretracted_dois(s).select("id", "doi").join(notes, "doi", "left").select("id", F.col("note").alias("_note"), F.lit(True).alias("_due"))
    rows = s.sources.join(due, "id", "left")
    swept = rows.withColumn("retracted", F.col("retracted") | F.col("_note").isNotNull()).withColumn("retraction_note", F.coalesce("_note", "retraction_note")).withColumn("last_checked_at", F.when(F.col("_due"), now).otherwise(F.col("last_checked_at")))
    counts = due.agg(F.count("*").alias("checked"), F.count("_note").alias("updated"))
    return s.with_tables(sources=completed(swept, "sources")), counts
