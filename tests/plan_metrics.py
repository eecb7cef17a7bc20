"""What the nodes of a plan did, once it has run."""

from __future__ import annotations


def nodes(plan):
    """All nodes of a physical plan, through adaptive execution, reuse and subqueries."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
        return
    if name.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
        return
    yield plan
    for children in (plan.children(), plan.subqueries()):
        for k in range(children.size()):
            yield from nodes(children.apply(k))


def metric(node, name):
    found = node.metrics().get(name)
    return found.get().value() if found.isDefined() else None


def shuffled(frame):
    """Text and rows written of every shuffle, of a plan that is run for it."""
    frame.collect()
    out = []
    for node in nodes(frame._jdf.queryExecution().executedPlan()):
        if "ShuffleExchange" in node.getClass().getSimpleName():
            out.append((node.toString().split("\n")[0], metric(node, "shuffleRecordsWritten")))
    return out
