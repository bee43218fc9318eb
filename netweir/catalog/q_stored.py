"""The central reads once more, over a stored lake: tables written by day, opened again, pruned by ``dt``."""

from __future__ import annotations

from functools import cached_property

from .. import schema
from ..plans.lake import Lake, store_rollups
from ..plans.rollup import ROLLUPS
from ..plans.sizing import scratch_dir
from ..sources import tables
from . import q_flows, q_ops, q_reads  # noqa: F401  (their queries are registered first)
from .context import Context
from .registry import ORACLES, QUERIES, query

TABLES = ("traffic_by_dst_1min", "traffic_by_src_1min", "traffic_by_as", "traffic_by_link", "traffic_by_link_hourly", "traffic_by_link_daily")
READS = (
    "TOP-01_top_as_filtered", "SER-03_as_series", "SER-04_as_link_series", "PCT-05_link_p95_total", "ALR-01_volume_in", "ALR-02_volume_out", "ALR-03_syn_flood",
    "ALR-04_amplification", "ALR-08_port_scan", "ALR-09_subnet_flood", "ALR-10_smtp_abuse", "ALR-11_link_capacity", "ALR-12_anomaly",
)


class StoredContext(Context):
    """Distinct counts come from the stored sketches (exact as long as they are small)."""

    exact = False

    @cached_property
    def ev(self) -> Lake:
        root = scratch_dir(self.spark, "lake")
        flows = self.enriched("ev")
        tables.write_flows(flows, f"{root}/flows")
        # the rollups read the flows just written: they are decoded and enriched once
        written = self.spark.read.schema(flows.select(*schema.FLOW.names).schema).parquet(f"{root}/flows")
        store_rollups(written, root, [ROLLUPS[n] for n in TABLES])
        return Lake.open(self.spark, root, TABLES)


_STORED: dict[tuple[str, str], StoredContext] = {}


def _stored(c: Context) -> StoredContext:
    return _STORED.setdefault((c.spark.sparkContext.applicationId, c.dir), StoredContext(c.spark, c.dir))


for _name in READS:
    query(f"{_name}_stored", ORACLES[_name])(lambda c, fn=QUERIES[_name]: fn(_stored(c)))
