"""Stages from the command line: python -m ridgework.cli CELLS OUT [--stage full|topo|prom|path|db] [--cutoff M].

CELLS is a Parquet table of x, y, z; or with --index a catalog file, with --series, --bound and --root,
whose raw rasters are read. Each stage leaves its tables under OUT for the next.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ridgework.plans.terrain import Terrain
from ridgework.sources import rasters

#: Which results each stage writes.
STAGES = {"topo": ["edges"], "prom": ["relations", "ranks", "tree"], "path": ["between", "pruned", "lines", "domains"], "db": []}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("cells")
    p.add_argument("out")
    p.add_argument("--stage", choices=["full", *STAGES], default="full")
    p.add_argument("--cutoff", type=float, default=20.0)
    p.add_argument("--index")
    p.add_argument("--series", default="")
    p.add_argument("--bound", default=":global")
    p.add_argument("--grid", type=int, help="the grid of an index that holds several")
    p.add_argument("--debug", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.index:
        _, dems = rasters.load_catalog(spark, a.index)
        dems = rasters.select_dems(dems, a.bound, a.series)
        held = [r.grid_id for r in dems.select("grid_id").distinct().orderBy("grid_id").collect()]  # a row per grid
        if a.grid is None and len(held) > 1:
            raise SystemExit(f"the files are of grids {held}, whose cells would fall on one another: choose one by --grid")
        dems = dems if a.grid is None else dems.where(dems.grid_id == a.grid)
        cells = rasters.overlaid(rasters.samples(rasters.read_raw(dems, a.cells), dems))
    else:
        cells = spark.read.parquet(a.cells)
    t = Terrain(cells.select("x", "y", "z"), a.cutoff)
    for stage, names in STAGES.items():
        if a.stage not in ("full", stage):
            # an earlier stage's tables stand in for its results
            for n in names:
                if _exists(spark, f"{a.out}/{n}"):
                    t.__dict__[n] = spark.read.parquet(f"{a.out}/{n}")
            continue
        for n in names:
            getattr(t, n).write.mode("overwrite").parquet(f"{a.out}/{n}")
        if stage == "db":
            t.publish(a.out)
            if a.debug:
                t.debug(f"{a.out}/debug")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


if __name__ == "__main__":
    main()
