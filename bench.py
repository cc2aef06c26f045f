"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

QUERIES = ["summarise_geno", "summarise_geno_rare", "summarise_splitby", "filter_variants_maf", "map_variants", "aggregate_units", "acat_units", "gsa_lm", "block_corr", "cds_map", "remap_4key", "build_varset", "gene_set_burden", "vcf_parse", "lm_burden"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from varloom.plans import registry

    found, times = registry.queries(), {}
    found[QUERIES[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    for name in QUERIES:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
