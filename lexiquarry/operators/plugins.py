"""Plug-ins of one's own: what each kind takes and gives, checked before its result is used.

A plug-in is a function of a DataFrame.  Its kind says which columns it must give back, and that it gives a row for every row it
takes, told apart by keys; one that loses, doubles or makes up rows, lacks a column or gives another type is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


@dataclass(frozen=True)
class Kind:
    """Keys that name a row, and the columns that a plug-in of this kind adds (a DDL)."""

    keys: tuple[str, ...]
    gives: str


KINDS = {
    "classifier": Kind(("question_id",), "intent string"),
    "normalizer": Kind(("question_id",), "norm string"),
    "embedder": Kind(("text_id",), "embedding array<float>"),
    "reranker": Kind(("question_id", "source_type", "source_id"), "rerank_score double"),
    "validator": Kind(("question_id",), "passed boolean, issues array<string>, score double"),
    "runtime_answer": Kind(("question_id",), "answer_text string, answer_mode string"),
    "sampling": Kind(("answer_id",), "ask boolean, reason string"),
    "ingestion_stage": Kind(("document_id",), "error string"),
}


class Refused(ValueError):
    """A plug-in whose result can't be used."""


class Registry:
    """Plug-ins by kind and name."""

    def __init__(self):
        self._found: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {}

    def add(self, kind: str, name: str, do: Callable[[DataFrame], DataFrame]) -> None:
        if kind not in KINDS:
            raise Refused(f"no kind {kind}; there are {', '.join(KINDS)}")
        if (kind, name) in self._found:
            raise Refused(f"{kind} {name} is there already")
        self._found[kind, name] = do

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._found if k == kind)

    def run(self, kind: str, name: str, rows: DataFrame, *, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The plug-in's result, checked: columns and types from its plan, rows by one comparison of keys and counts.

        The check runs the plug-in; ``settle`` (such as a write to the store) keeps it from running again where the result is used.
        """
        if (kind, name) not in self._found:
            raise Refused(f"no {kind} {name}; there are {', '.join(self.names(kind)) or 'none'}")
        out = self._found[kind, name](rows)
        _columns_fit(kind, name, rows, out)
        if settle is not None:
            out = settle(out)
        wrong = _row_faults(rows, out, KINDS[kind].keys)
        if wrong:
            raise Refused(f"{kind} {name}: {wrong}")
        return out


def _columns_fit(kind: str, name: str, rows: DataFrame, out: DataFrame) -> None:
    wanted = _parse_datatype_string(KINDS[kind].gives)
    assert isinstance(wanted, StructType)
    have = {f.name: f.dataType for f in out.schema}
    need = {f.name: f.dataType for f in wanted} | {k: rows.schema[k].dataType for k in KINDS[kind].keys}
    faults = [f"lacks {n}" if n not in have else f"{n} is {have[n].simpleString()}, not {t.simpleString()}" for n, t in need.items() if have.get(n) != t]
    if faults:
        raise Refused(f"{kind} {name}: {'; '.join(faults)}")


def _row_faults(rows: DataFrame, out: DataFrame, keys: tuple[str, ...]) -> str | None:
    """What is wrong with the rows, if anything: keys are counted on both sides and the counts compared, null keys too."""
    key = F.struct(*keys)
    told = rows.select(key.alias("key"), F.lit(1).alias("taken"), F.lit(0).alias("given")).unionByName(out.select(key.alias("key"), F.lit(0).alias("taken"), F.lit(1).alias("given")))
    per = told.groupBy("key").agg(F.sum("taken").alias("taken"), F.sum("given").alias("given"))
    r = per.agg(F.sum(F.greatest(F.col("taken") - F.col("given"), F.lit(0))).alias("lost"), F.sum(F.when(F.col("taken") > 0, F.greatest(F.col("given") - F.col("taken"), F.lit(0)))).alias("doubled"), F.sum(F.when(F.col("taken") == 0, F.col("given"))).alias("made_up")).first()
    faults = [f"{n} rows {what}" for what, n in (("lost", r.lost), ("doubled", r.doubled), ("made up", r.made_up)) if n]
    return ", ".join(faults) or None
