"""python -m ledgerloom COMMAND, one of
list
run QUERY SF_DIR [OUT]
clean RAW_DIR LOG INVENTORY OUT
split DATASET OUT
train DATASET MANIFEST RUN
final DATASET MANIFEST RUN
evaluate RUN [DATASET]"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .operators.profile import coverage
from .operators.split import build_manifest, check_manifest
from .plans import queries, runs, vehicles
from .sources import files, sinks


def clean(spark, raw_dir: str, log: str, inventory: str, out: str, least: int = 1000) -> int:
    """The audited tables of a snapshot, each with its content hash; 1 if fewer rows than least."""
    checked = vehicles.integrity_reasons(files.json_folder(spark, raw_dir), files.request_log(spark, log), files.inventory(spark, inventory))
    tables = vehicles.build(vehicles.normalise(checked, "integrity"))
    hashes = {name: sinks.write_table(df, f"{out}/{name}") for name, df in tables.items()}
    n = spark.read.parquet(f"{out}/vehicles.parquet").count()
    sinks.write_json(f"{out}/schema.json", {"hashes": hashes, "rows": n})
    return int(n < least)


def freeze(spark, dataset: str, out: str) -> int:
    """A sealed grouped split with folds and its coverage."""
    df = files.dataset(spark, dataset, "vehicle_id")
    m = build_manifest(df, "vehicle_id", "model_group")
    if check_manifest(df, m, "vehicle_id", "model_group").where("n > 0").count():
        return 1
    sinks.write_table(m, f"{out}/split_manifest", csv=True)
    sinks.write_table(coverage(df.join(m.select("vehicle_id", "split"), "vehicle_id"), "split", ["model_year", "manufacturer", "vehicle_class"]), f"{out}/split_coverage")
    sinks.seal(f"{out}/split.json", {"dataset": df, "manifest": m}, {"test_share": 0.2, "seed": 42, "folds": 5})
    return 0


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(queries.QUERIES))
        return 0
    spark = SparkSession.builder.appName("ledgerloom").getOrCreate()
    if args[:1] == ["run"] and len(args) in (3, 4):
        df = queries.QUERIES[args[1]](spark, args[2])
        print(sinks.write_table(df, args[3]) if len(args) == 4 else sinks.markdown(df, 50))
        return 0
    if args[:1] == ["clean"] and len(args) == 5:
        return clean(spark, *args[1:])
    if args[:1] == ["split"] and len(args) == 3:
        return freeze(spark, *args[1:])
    if args[:1] in (["train"], ["final"]) and len(args) == 4:
        print(getattr(runs, args[0])(spark, *args[1:])["selected_model"])
        return 0
    if args[:1] == ["evaluate"] and len(args) in (2, 3):
        print(runs.evaluate_run(spark, *args[1:]))
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
