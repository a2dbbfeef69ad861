"""How many rows the steps of a finished plan made."""

from __future__ import annotations


def _children(node):
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if name.endswith("QueryStageExec"):
        return [node.plan()]
    if name == "ReusedExchangeExec":
        return []
    found = node.children()
    return [found.apply(i) for i in range(found.size())]


def most_rows(df, metric: str = "numOutputRows") -> int:
    """Runs ``df`` and returns the rows of the step that made most, by a metric."""
    df.collect()
    waiting, most = [df._jdf.queryExecution().executedPlan()], 0
    while waiting:
        node = waiting.pop()
        counted = node.metrics().get(metric)
        most = max(most, counted.get().value() if counted.isDefined() else 0)
        waiting += _children(node)
    return most
