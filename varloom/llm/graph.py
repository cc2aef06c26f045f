"""Connected components of a link table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import drop_stage, stage_table


def components(links: DataFrame) -> DataFrame:
    """v, label (the smallest v reachable) of every end of ``links`` (a, b: longs).

    Labels spread along links and then jump to the label of their label, until none changes. Minima
    combine before the shuffle; the joins read tables in the shared folder, whose hot keys adaptive
    execution splits. No links give no rows.
    """
    both = stage_table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stage_table(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.min("label").alias("m"))
        told = stage_table(labels.join(heard, "v").select("v", F.least("label", "m").alias("label"), F.col("label").alias("old")), "told")
        of = told.select(F.col("v").alias("label"), F.col("label").alias("far"))
        jumped = stage_table(told.join(of, "label").select("v", F.least("label", "far").alias("label"), "old"), "labels")
        changed = jumped.where("label <> old").limit(1).count()
        drop_stage(told)
        drop_stage(labels)
        labels = stage_view(jumped)
        if not changed:
            drop_stage(both)
            return labels


def stage_view(jumped: DataFrame) -> DataFrame:
    out = jumped.select("v", "label")
    out.stage_path = jumped.stage_path
    return out
