"""An HTML report of one run. Its tables are small aggregates of that run; the page is put together on the driver."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN = 50
BADGES = {"valid": "valid", "hallucination": "hallucination", "partially_valid": "partial", "unverifiable": "unverifiable"}
_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font-family:sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:4px 8px}}.hallucination{{background:#fdd}}.valid{{background:#dfd}}.partial{{background:#ffd}}</style>
</head><body><h1>{title}</h1><p>{when}</p>{sections}</body></html>"""


def cut_text(table: DataFrame, column: str = "text") -> DataFrame:
    """The text as a table shows it: its first characters, with dots if it has more."""
    c = F.col(column)
    return table.withColumn(column, F.when(F.length(c) > SHOWN, F.concat(F.left(c, F.lit(SHOWN)), F.lit("..."))).otherwise(c))


def numbered(verdicts: DataFrame) -> DataFrame:
    """Rows of the report: place (from 1), text, claim_type, result, verdict_confidence, reason, in order of extraction; of one run."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id", "run_id").orderBy("ord")
    return cut_text(verdicts.select("file_id", "run_id", F.row_number().over(w).alias("place"), "text", "claim_type", "result", "verdict_confidence", "reason"))


def type_totals(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("file_id", "run_id", "claim_type").agg(F.count(F.lit(1)).alias("n"))


def _table(head: list[str], rows: list[tuple], marks: list[str] | None = None) -> str:
    cells = lambda r, t: "".join(f"<{t}>{html.escape(str(x))}</{t}>" for x in r)
    body = "".join(f'<tr class="{marks[k] if marks else ""}">{cells(r, "td")}</tr>' for k, r in enumerate(rows))
    return f"<table><tr>{cells(head, 'th')}</tr>{body}</table>"


def render(title: str, when: str, summary: dict, metric_rows: list[tuple], types: list[tuple], claim_rows: list[tuple], recommendations: list[str]) -> str:
    """The page: summary, metrics, claims by type, all claims, hallucinations, recommendations."""
    bad = [r for r in claim_rows if r[3] == "hallucination"]
    sections = [
        f"<h2>Summary</h2>{_table(['', ''], [*summary.items()])}",
        f"<h2>Metrics</h2>{_table(['metric', 'value'], metric_rows)}",
        f"<h2>Claims by type</h2>{_table(['type', 'claims'], types)}",
        f"<h2>Claims</h2>{_table(['#', 'claim', 'type', 'result', 'confidence', 'reason'], claim_rows, [BADGES.get(r[3], '') for r in claim_rows])}",
        f"<h2>Hallucinations</h2>{_table(['#', 'claim', 'type', 'result', 'confidence', 'reason'], bad)}" if bad else "",
        f"<h2>Recommendations</h2><ul>{''.join(f'<li>{html.escape(r)}</li>' for r in recommendations)}</ul>",
    ]
    return _PAGE.format(title=html.escape(title), when=html.escape(when), sections="".join(sections))


def generate(verdicts: DataFrame, summary: DataFrame, metric_rows: DataFrame, recommendations: DataFrame, file_id: str, run_id: str, title: str = "Verification report") -> str:
    """The page of one run: only rows of that run come to the driver."""
    own = lambda t: t.where((F.col("file_id") == file_id) & (F.col("run_id") == run_id))
    when = verdicts.sparkSession.sql("SELECT date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss') AS t").first()["t"]
    s = own(summary).first()
    rows = [tuple(r[2:]) for r in own(numbered(verdicts)).orderBy("place").collect()]
    metrics = [(r["name"], f"{r['value']:.2f}") for r in own(metric_rows).orderBy("name").collect()]
    types = [(r["claim_type"], r["n"]) for r in own(type_totals(verdicts)).orderBy("claim_type").collect()]
    words = [r["recommendation"] for r in own(recommendations).orderBy("place", "of").collect()]
    return render(title, when, {k: v for k, v in (s.asDict() if s else {}).items() if k not in ("file_id", "run_id")}, metrics, types, rows, words)


def save(page: str, path: str) -> str:
    """Writes the page, with the folders above it; returns its path."""
    to = Path(path)
    to.parent.mkdir(parents=True, exist_ok=True)
    to.write_text(page, encoding="utf-8")
    return str(to)


def console(verdicts: DataFrame, k: int = 5) -> str:
    """Counts by result and the first k hallucinations, as text."""
    counts = verdicts.groupBy("result").count().orderBy("result").collect()
    first = verdicts.where("result = 'hallucination'").orderBy("file_id", "run_id", "ord").limit(k).collect()
    return "\n".join([*(f"{r['result']}: {r['count']}" for r in counts), *(f"- {r['text']}: {r['reason']}" for r in first)])
