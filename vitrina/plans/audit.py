"""Plan audit: the physical shape of every registered query.

``python -m vitrina.plans.audit [sf_dir] > PLANS.md`` prints, per query:

* the plan with broadcasts disabled (every join a shuffle join, the shape a
  query takes when all its inputs are large): exchanges, join kinds;
* the final adaptive plan after running at ``sf_dir``: exchanges, join kinds,
  and markers worth checking (partial WindowGroupLimit, Expand for multiple
  distinct aggregates, nested-loop or cartesian joins, Python evaluation).
"""

from __future__ import annotations

import re
import sys
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

JOINS = ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")
MARKERS = ("WindowGroupLimit", "Expand", "BatchEvalPython", "ArrowEvalPython", "BroadcastNestedLoopJoin", "CartesianProduct")


def plan_text(df: DataFrame, executed: bool) -> str:
    """Physical plan; with ``executed`` the frame's own plan is run first so
    the adaptive plan is final (a dev tool: results are small at test sizes)."""
    if executed:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def summarize(plan: str) -> dict[str, object]:
    # a final adaptive plan prints its final and initial plans; only the
    # top-level marker (column 0) splits them: cached relations nest their own
    plan = plan.split("\n+- == Initial Plan ==")[0]
    exchanges = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
    joins = Counter({j: plan.count(j + " ") + plan.count(j + "(") for j in JOINS})
    return {
        "exchanges": exchanges,
        "broadcasts": plan.count("BroadcastExchange"),
        "joins": ", ".join(f"{k.replace('Join', '')}×{v}" for k, v in joins.items() if v),
        "markers": ", ".join(m for m in MARKERS if m in plan),
    }


def main(argv: list[str]) -> None:
    from ..session import local_session
    from .registry import queries

    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    spark: SparkSession = local_session(8, 16, app="vitrina-audit")
    rows = []
    for key, fn in queries().items():
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        worst = summarize(plan_text(fn(spark, sf_dir), executed=False))
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
        final = summarize(plan_text(fn(spark, sf_dir), executed=True))
        rows.append((key, worst, final))
    print("# PLANS\n")
    print(f"Generated by `python -m vitrina.plans.audit {sf_dir}`. *All shuffled* = broadcasts disabled,")
    print("the shape when every input is large; *final* = AQE's executed plan at this scale factor.\n")
    print("| key | all shuffled: exchanges | joins | final: exchanges | broadcasts | joins | markers |")
    print("|---|---|---|---|---|---|---|")
    for key, w, f in rows:
        print(
            f"| {key} | {w['exchanges']} | {w['joins'] or '-'} | {f['exchanges']} | {f['broadcasts']} | "
            f"{f['joins'] or '-'} | {f['markers'] or '-'} |"
        )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
