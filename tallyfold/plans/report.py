"""What a plan did: partial and final group counts, and benchmark reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def parallelism(df: DataFrame) -> int:
    """Tasks that run at once."""
    return df.sparkSession.sparkContext.defaultParallelism


def explain(df: DataFrame) -> str:
    """The formatted physical plan."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def profile(df: DataFrame) -> dict[str, float]:
    """Run ``df`` without keeping its rows and return rows of the partial and the final aggregation and their ratio."""
    qe = df._jdf.queryExecution()
    qe.executedPlan().execute().count()
    counts: list[int] = []
    stack = [qe.executedPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            stack.append(node.plan())
            continue
        if "HashAggregate" in name or name == "SortAggregate":
            metric = node.metrics().get("numOutputRows")
            counts.append(metric.get().value() if metric.isDefined() else 0)
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    final, partial = (counts[0], counts[-1]) if counts else (0, 0)
    return {"partial_groups": partial, "final_groups": final, "ratio": partial / final if final else 0.0}


def save_markdown(rows: list[dict], path: str, title: str = "Benchmark") -> None:
    """A table of results; columns in the order of the first row."""
    names = list(rows[0]) if rows else []
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows)]
    Path(path).write_text("\n".join(lines) + "\n")


def save_json(payload: dict, path: str) -> None:
    Path(path).write_text(json.dumps(payload, indent=2, sort_keys=True) + "\n")
