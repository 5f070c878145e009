"""One pass over a log for all analyses.

The log is read once and counted by several sets of columns together (GROUPING SETS), each of which
is combined in the tasks before it is shuffled. The result is written once, a folder per section, and
every analysis reads the smallest section that has what it needs. Operators accept a section like a
log, because it has the number of log rows in `flow_count`.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.counts import grouped_counts
from flowsieve.operators.traffic import is_after_hours
from flowsieve.schema import FLOW_COUNT
from flowsieve.sources.scratch import new_scratch_path
from flowsieve.sources.tables import REJECTED, ROW

_AFTER = "after_hours_row"
# Each section with its columns; a log without one of them has no such section.
SECTIONS: dict[str, tuple[str, ...]] = {
    "flow": ("src_ip", "dst_ip", "dst_port", "rule_name"),
    "plain_flow": ("src_ip", "dst_ip", "dst_port"),
    "pair": ("src_ip", "dst_ip"),
    "source": ("src_ip",),
    "destination": ("dst_ip",),
    "port": ("dst_port",),
    "hour": ("hour", "day_of_week"),
    "zones": ("ingress_zone", "egress_zone"),
    "after_hours": (_AFTER,),
    "rejected": (REJECTED,),
}


class LogSections:
    """The counts of one log by section, written when first asked for.

    `flows` may be a log, with or without the column `rejected` of `load_logs(keep_rejected=True)`;
    rows that are no flows at all then only count there. All columns of the flows outside office hours
    are kept as well.
    """

    def __init__(self, flows: DataFrame):
        self.columns = [c for c in flows.columns if c not in (REJECTED, FLOW_COUNT)]
        placed = flows
        if REJECTED in flows.columns:
            is_flow = ~F.coalesce(F.exists(REJECTED, lambda r: r["column"] == ROW), F.lit(False))
        else:
            is_flow = F.lit(True)
        derived = {"is_flow": is_flow}
        if "ts" in flows.columns:
            every = F.struct(*[F.col(f"`{c}`") for c in self.columns])
            derived |= {"hour": F.hour("ts"), "day_of_week": F.dayofweek("ts"), _AFTER: F.when(is_flow & is_after_hours(), every)}
        self._placed = placed.withColumns(derived)
        self.sections = {name: columns for name, columns in SECTIONS.items() if set(columns) <= set(self._placed.columns)}

    def counts(self) -> DataFrame:
        """All sections in one table: (section, is_flow, keys, flow_count); keys outside a section are null."""
        counted = grouped_counts(self._placed, self.sections, ["is_flow"])
        for name in ("after_hours", "rejected"):
            if name in self.sections:
                # the null key stands for all other rows, which other sections have
                counted = counted.where((F.col("section") != name) | F.col(self.sections[name][0]).isNotNull())
        return counted

    @cached_property
    def _table(self) -> DataFrame:
        counts = self.counts()
        path = new_scratch_path(counts.sparkSession, "log_sections")
        counts.write.partitionBy("section").parquet(path)
        return counts.sparkSession.read.schema(counts.schema).parquet(path)

    def of(self, section: str) -> DataFrame:
        """The columns of a section and `flow_count`, for flows only. The first call reads the log."""
        if section not in self.sections:
            raise ValueError(f"The log has no {section!r}: {SECTIONS.get(section, ())}")
        rows = self._table.where(F.col("section") == section)
        if section != "rejected":
            rows = rows.where("is_flow")
        return rows.select(*self.sections[section], FLOW_COUNT)

    def after_hours(self) -> DataFrame:
        """The flows outside office hours with all their columns, a row per log row."""
        rows = self.of("after_hours").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(FLOW_COUNT))))
        return rows.select(*[F.col(f"{_AFTER}.`{c}`") for c in self.columns])
