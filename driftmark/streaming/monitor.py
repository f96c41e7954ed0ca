"""A stream watched against a stored profile: each micro-batch is profiled and compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from driftmark.operators.compare import Sensitivity
from driftmark.operators.profile import SKETCH, Profile, profile
from driftmark.plans.analyze import Report, report_on
from driftmark.plans.rules import RuleSet

#: Findings about the size of a batch, which says nothing about its content.
SIZE_KINDS = ("row_count_increased", "row_count_decreased")


def watch(
    stream: DataFrame,
    baseline: Profile,
    on_report: Callable[[int, Report], None],
    checkpoint: str,
    rules: RuleSet | None = None,
    how: Sensitivity = Sensitivity(),
    mode: str = SKETCH,
    **trigger: object,
) -> StreamingQuery:
    """Calls on_report(batch id, report) for each batch that has rows.

    Changes of the row count are left unclassified, unless the rules say otherwise.
    """
    rules = rules or RuleSet(tuple((s, r) for s, r in RuleSet.load().ranked if r.kind not in SIZE_KINDS))

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            found = profile(held, f"batch {number}", mode)
            if found.rows:
                on_report(number, report_on(baseline, found, rules, how=how))
        finally:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
