"""Session defaults, and the shared folder in which lineage may be cut."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return prepared(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("parcelforge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepared(spark: SparkSession) -> SparkSession:
    """The session, ready for the queries. Python workers on machines that have this package at the same place find it there
    (elsewhere it comes with --py-files), and unions whose children are partitioned alike are not zipped by
    partition. Spark 4.1 does that even after adaptive execution has coalesced or split the children differently, and then fails."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where none is named and Spark runs in one process, as in tests, a fresh local one;
    on a cluster a folder of one machine would lose the rows with it, so a missing setting is an error there."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="parcelforge-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from the files, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
