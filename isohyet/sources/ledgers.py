"""Submission records: history text, leaderboard text and nested JSON ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Line formats of the history and leaderboard listings.
STAMP = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+"
HISTORY_LINE = rf"^(\S+)\s+({STAMP})\s+(.*?)\s+\S*\.COMPLETE(?:\s+([0-9.]+))?(?:\s+([0-9.]+))?\s*$"
LEADERBOARD_LINE = rf"^\s*(\d+)\s+(.+?)\s+({STAMP})\s+([0-9.]+)\s*$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def parse_history(lines: DataFrame, column: str = "value") -> DataFrame:
    """Completed submissions: file, time, description, public and private score; other lines are skipped."""
    text = F.trim(F.col(column))
    part = lambda i: F.regexp_extract(text, HISTORY_LINE, i)
    return lines.filter(text.rlike(HISTORY_LINE)).select(
        part(1).alias("file_name"), part(2).alias("submitted_at"), _squeeze(part(3)).alias("description"),
        part(4).try_cast("double").alias("public_score"), part(5).try_cast("double").alias("private_score"))


def parse_leaderboard(lines: DataFrame, column: str = "value") -> DataFrame:
    text = F.col(column)
    part = lambda i: F.regexp_extract(text, LEADERBOARD_LINE, i)
    return lines.filter(text.rlike(LEADERBOARD_LINE)).select(
        part(1).try_cast("bigint").alias("team_id"), _squeeze(part(2)).alias("team_name"),
        part(3).alias("submitted_at"), part(4).try_cast("double").alias("score"))


LEDGER_SCHEMA = (
    "ledger string, items array<struct<path string, submission string, ref bigint, public_mae double, sha12 string,"
    " delta_to_anchor double, label string, decision string>>"
)


def read_ledgers(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """A directory of JSON ledgers, one document per file or one per line."""
    return spark.read.schema(LEDGER_SCHEMA).json(path, multiLine=one_per_file)


def flatten_ledgers(ledgers: DataFrame) -> DataFrame:
    """One row per (path, ref): the entry of the newest ledger, later positions losing to earlier ones."""
    items = ledgers.select("ledger", F.posexplode("items").alias("pos", "item")).select(
        "ledger", "pos", F.coalesce("item.submission", "item.path").alias("path"), F.col("item.ref").alias("ref"),
        "item.public_mae", "item.sha12", "item.delta_to_anchor", "item.label", "item.decision")
    rest = ["ledger", "pos", "public_mae", "sha12", "delta_to_anchor", "label", "decision"]
    newest = F.max_by(F.struct(*rest), F.struct("ledger", -F.col("pos")))
    return items.groupBy("path", "ref").agg(newest.alias("_r")).select("path", "ref", "_r.*").drop("pos")
