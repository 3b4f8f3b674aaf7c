"""Result tables in Markdown from the summaries that ``retrieval.write_score`` leaves."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import SparkSession

from tessella.sources import jsonl

#: Heading, stratum and metric of every column.
COLUMNS = (
    ("Hit@1", "all", "hit_1"), ("MRR@10", "all", "mrr_10"), ("nDCG@10", "all", "ndcg_10"), ("Recall@10", "all", "recall_10"),
    ("Recall@20", "all", "recall_20"), ("FullCoverage@10", "all", "full_coverage_10"), ("Multi FullCoverage@10", "multi", "full_coverage_10"),
)
NOTE = "Bold: the best value of a column. It says nothing of significance."


class System(NamedTuple):
    """A row of a table: its name and label, and the folder and stage of its summary."""

    method: str
    label: str
    stage: str
    folder: str


def load_summary(spark: SparkSession, folder: str, stage: str, benchmark: str = "hard") -> dict:
    """The summary of a stage and benchmark in ``folder``: ``summary.json``, or a file named by both."""
    tried = [f"{folder}/summary.json", f"{folder}/{stage}_{benchmark}_summary.json"]
    for path in tried:
        if jsonl.exists(spark, path):
            found = jsonl.read_json(spark, path)
            if found.get("stage") == stage and found.get("benchmark", found.get("tier")) == benchmark:
                return found
    raise FileNotFoundError(f"no {benchmark} {stage} summary: {', '.join(tried)}")


def values(summary: dict, where: str = "the summary") -> list[float]:
    """The value of every column; one that is missing or no number is an error."""
    out = []
    for heading, stratum, metric in COLUMNS:
        value = (summary.get("metrics") or {}).get(stratum, {}).get(metric)
        if not isinstance(value, int | float) or isinstance(value, bool):
            raise ValueError(f"{where} has no {heading}")
        out.append(float(value))
    return out


def table(title: str, rows: Sequence[tuple[str, str, Sequence[float]]], stage_heading: str = "Stage", bold_best: bool = True) -> str:
    """(method, label, values) rows as a table with four decimals; the best of each column in bold."""
    best = [max(column) for column in zip(*(v for _, _, v in rows))]
    shown = lambda v, top: f"**{v:.4f}**" if bold_best and v == top else f"{v:.4f}"
    cells = [["Method", stage_heading, *(h for h, _, _ in COLUMNS)], ["---", *["---:"] * (len(COLUMNS) + 1)]]
    cells += [[method, label, *map(shown, v, best)] for method, label, v in rows]
    lines = [f"# {title}", "", *("| " + " | ".join(c) + " |" for c in cells), *(["", f"> {NOTE}"] if bold_best else [])]
    return "\n".join(lines) + "\n"


def write_table(spark: SparkSession, reports: str, systems: Sequence[System], title: str, out: str, stage_heading: str = "Stage", bold_best: bool = True, benchmark: str = "hard") -> str:
    """Loads the systems' summaries from under ``reports`` and writes their table to ``out``; returns it."""
    rows = [(s.method, s.label, values(load_summary(spark, f"{reports}/{s.folder}", s.stage, benchmark), s.folder)) for s in systems]
    text = table(title, rows, stage_heading, bold_best)
    jsonl.write_text(spark, text, out)
    return text
