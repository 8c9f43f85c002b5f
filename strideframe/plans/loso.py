"""Leave one subject out: prepared windows, the scenarios of every fold, and their summary, from one call."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.errors import ArtifactError, SplitError
from strideframe.operators.evaluate import SCENARIOS, evaluate_scenarios, summarize_scenarios
from strideframe.plans.folds import checksum, fold_results, run_folds
from strideframe.session import stored


def run_loso(
    windows: DataFrame,
    root: str,
    *,
    subject: str,
    label: str,
    flat: str,
    key: str,
    classes: int,
    synthetic: DataFrame | None = None,
    synthetic_subject: str | None = None,
    held_out: Iterable | None = None,
    scenarios: Iterable[str] = SCENARIOS,
    scarce: int = 2,
    synthetic_cap: int = 500,
    parallel: int = 4,
    resume: bool = True,
    **forest,
) -> tuple[DataFrame, DataFrame]:
    """(records, summary): per fold and scenario, and per scenario over the folds.

    ``windows`` (subject, label, flat window, key) are computed and stored
    once; every fold reads them.  A fold holds one subject out (those of
    ``held_out``, all by default), trains on all others (with the synthetic
    windows of its own ``synthetic_subject`` column, or all of them) and tries
    the subject.  Folds run ``parallel`` at a time; one that fails cancels the
    others.  Results and manifests lie under ``root``: the same call goes on
    after a failure and skips the folds that are done, unless settings, windows
    or synthetic windows have changed.
    """
    scenarios = [s.lower() for s in scenarios]
    real = stored(windows.select(subject, label, flat, key), "windows")
    made = None if synthetic is None else stored(synthetic.select(*[c for c in (synthetic_subject,) if c], label, flat, key), "synthetic")
    subjects = sorted(r[0] for r in real.select(subject).distinct().where(F.col(subject).isNotNull()).collect())  # a fold each
    folds = subjects if held_out is None else list(held_out)
    if not folds or set(folds) - set(subjects) or len(subjects) < 2:
        raise SplitError(f"no folds over {len(subjects)} subjects, or unknown ones: {sorted(set(folds) - set(subjects))[:5]}")
    settings = {
        "scenarios": scenarios, "scarce": scarce, "synthetic_cap": synthetic_cap, "classes": classes, "forest": {k: forest[k] for k in sorted(forest)},
        "windows": list(map(str, checksum(real))), "synthetic": None if made is None else list(map(str, checksum(made))),
    }

    def fold(subject_out) -> DataFrame:
        own = made if made is None or synthetic_subject is None else made.where(F.col(synthetic_subject) == F.lit(subject_out))
        return evaluate_scenarios(
            real.where(F.col(subject) != F.lit(subject_out)), real.where(F.col(subject) == F.lit(subject_out)), own, label, flat, key, classes, scenarios=scenarios, scarce=scarce, synthetic_cap=synthetic_cap, **forest
        )

    states = run_folds(real.sparkSession, fold, folds, root, settings, resume=resume, parallel=parallel, stop_on_failure=True)
    if failed := [(r.fold, r.error) for r in states.collect() if r.status == "failed"]:
        raise ArtifactError(f"folds failed, the others were cancelled: {failed}")
    records = fold_results(real.sparkSession, folds, root, settings)
    return records, summarize_scenarios(records)
