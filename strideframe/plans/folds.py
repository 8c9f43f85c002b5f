"""Runs of one job per fold that can be taken up again."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.errors import ArtifactError
from strideframe.sources.artifacts import identity

MANIFEST = "fold string, plan string, n_rows long, checksum string"


def checksum(df: DataFrame) -> tuple[int, str]:
    """Rows and a digest of them that doesn't depend on their order."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])))
    r = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("s")).first()
    return r["n"], r["s"] or "0"


def _there(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.schema("x string").json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def completed(spark: SparkSession, root: str, fold, plan: str) -> bool:
    """A fold counts as done only when its manifest names this plan and its rows still have the manifest's checksum."""
    if not (_there(spark, f"{root}/manifests/{fold}") and _there(spark, f"{root}/results/{fold}")):
        return False
    found = spark.read.schema(MANIFEST).json(f"{root}/manifests/{fold}").collect()
    return len(found) == 1 and found[0]["plan"] == plan and (found[0]["n_rows"], found[0]["checksum"]) == checksum(spark.read.parquet(f"{root}/results/{fold}"))


def run_folds(
    spark: SparkSession, run_fold: Callable[[object], DataFrame], folds: Iterable, root: str, settings: dict, *, resume: bool = True, dry_run: bool = False, parallel: int = 1, stop_on_failure: bool = False
) -> DataFrame:
    """(fold, status, error) of every fold; results go to ``root/results/<fold>``, manifests to ``root/manifests/<fold>``.

    ``settings`` (JSON) identify the plan: other settings run all folds again.
    With ``resume``, folds that are done are skipped; without it, an existing
    one is an error.  ``parallel`` folds submit their jobs at a time, so that
    the tail of one fills with tasks of the next.  A fold that fails leaves the
    others running and no manifest; with ``stop_on_failure`` the jobs of the
    others are cancelled by their tag, and what hasn't ended is ``cancelled``.
    ``dry_run`` only says what would be done.
    """
    plan, folds = identity(settings), list(folds)
    done = {fold: completed(spark, root, fold, plan) for fold in folds}
    if not resume and any(done.values()):
        raise ArtifactError(f"folds are there already: {[f for f in folds if done[f]]}")
    tag, stop = f"folds-{uuid.uuid4().hex}", threading.Event()

    @inheritable_thread_target(spark)
    def run(fold) -> tuple[str, str, str | None]:
        if stop.is_set():
            return str(fold), "cancelled", None
        spark.sparkContext.addJobTag(tag)
        try:
            run_fold(fold).write.mode("overwrite").parquet(f"{root}/results/{fold}")
            n, digest = checksum(spark.read.parquet(f"{root}/results/{fold}"))
            spark.createDataFrame([(str(fold), plan, n, digest)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/manifests/{fold}")
        except Exception as failure:  # noqa: BLE001 - recorded, and the caller decides
            if stop.is_set():
                return str(fold), "cancelled", None
            if stop_on_failure:
                stop.set()
                spark.sparkContext.cancelJobsWithTag(tag)
            return str(fold), "failed", f"{type(failure).__name__}: {failure}"[:500]
        finally:
            spark.sparkContext.removeJobTag(tag)
        return str(fold), "ran", None

    states = {fold: (str(fold), "skipped" if done[fold] else "planned", None) for fold in folds if done[fold] or dry_run}
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        running = {fold: pool.submit(run, fold) for fold in folds if fold not in states}
    return spark.createDataFrame([states[f] if f in states else running[f].result() for f in folds], "fold string, status string, error string")


def fold_results(spark: SparkSession, folds: Iterable, root: str, settings: dict) -> DataFrame:
    """Rows of all folds with ``fold``; one that isn't done under these settings is an error."""
    plan, out = identity(settings), None
    for fold in folds:
        if not completed(spark, root, fold, plan):
            raise ArtifactError(f"fold {fold} isn't done")
        own = spark.read.parquet(f"{root}/results/{fold}").withColumn("fold", F.lit(str(fold)))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ArtifactError("no folds")
    return out
