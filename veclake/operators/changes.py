"""Change logs: latest write wins, folded over a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ("INSERT", "DELETE")


def latest(log: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """The last entry of each id.

    ``max_by`` aggregates in each task first: one row per id and task is
    shuffled, however often an id was written.
    """
    rest = [c for c in log.columns if c != id_col]
    out = log.groupBy(id_col).agg(F.max_by(F.struct(*rest), F.col(seq_col)).alias("_last"))
    return out.select(id_col, *[F.col(f"_last.{c}").alias(c) for c in rest])


def fold(log: DataFrame, id_col: str = "id", seq_col: str = "seq", action_col: str = "action") -> DataFrame:
    """Live records of a log; running it again over its own outcome changes nothing.

    Deletes of unknown ids are ignored.  An unknown action is an error.
    """
    known = F.when(F.col(action_col).isin(*ACTIONS), F.col(action_col)).otherwise(F.raise_error(F.concat(F.lit("unknown action "), F.coalesce(F.col(action_col), F.lit("null")))))
    return latest(log.withColumn(action_col, known), id_col, seq_col).where(F.col(action_col) == "INSERT").drop(action_col)


def recover(snapshot: DataFrame, log: DataFrame, id_col: str = "id", seq_col: str = "seq", action_col: str = "action") -> DataFrame:
    """Snapshot records (with the seq they were saved at) and the log after it, folded."""
    base = snapshot.withColumn(action_col, F.lit("INSERT")).select(log.columns)
    return fold(base.unionByName(log), id_col, seq_col, action_col)


def upsert(records: DataFrame, incoming: DataFrame, id_col: str = "id", order: str = "seq") -> DataFrame:
    """Whole-record replacement; of several incoming rows of an id the last wins."""
    new = latest(incoming, id_col, order).drop(order)
    return records.join(new.select(id_col), id_col, "left_anti").select(new.columns).unionByName(new)


def delete(records: DataFrame, gone: DataFrame, id_col: str = "id") -> DataFrame:
    return records.join(gone.select(id_col), id_col, "left_anti").select(records.columns)
