"""Grid search over boosted-tree parameters; every point is one distributed fit."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from itertools import product

from pyspark.sql import DataFrame

from barlab.plans.models import PRIMARY, ModelSpec, fit_and_evaluate, kept

TRIAL_SCHEMA = "spec string, trial_number int, overrides map<string,double>, metrics map<string,double>, score double, state string"


def grid_points(grid: Mapping[str, Sequence[float]]) -> list[dict[str, float]]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def tuned(spec: ModelSpec, overrides: Mapping[str, float]) -> ModelSpec:
    return replace(spec, params={**spec.params, **overrides})


def grid_search(
    train: DataFrame, val: DataFrame, spec: ModelSpec, grid: Mapping[str, Sequence[float]], parallelism: int = 2,
    scorer: Callable[[DataFrame, DataFrame, ModelSpec], Mapping[str, float]] | None = None,
    on_trial: Callable[[int, Mapping[str, float]], None] | None = None,
) -> DataFrame:
    """Trials table. Trial 0 is the untouched spec and is reused when the grid contains its values.

    ``scorer(train, val, spec)`` gives a trial's metrics, by default those of one fit; only they reach the driver.
    A trial that raises or has no finite primary metric ends as FAIL and the search goes on; if all do, that is an
    error. ``on_trial`` is told of every finished trial.
    """
    primary = PRIMARY[spec.objective]
    points = [p for p in grid_points(grid) if any(spec.params.get(k) != v for k, v in p.items())]
    cast = lambda p: {k: (int(v) if float(v).is_integer() and k != "stepSize" else v) for k, v in p.items()}

    score = scorer or (lambda a, b, s: fit_and_evaluate(a, b, s)[1].head().asDict())
    trials = [{}, *points]

    def run(i):
        try:
            found = score(rows_in, val, tuned(spec, cast(trials[i])))
            found = {k: (None if v is None else float(v)) for k, v in found.items()}
        except Exception as exc:  # noqa: BLE001 - one bad point must not end the search
            logging.getLogger(__name__).warning("trial %d of %s failed: %s", i, spec.name, exc)
            found = {}
        if on_trial:
            on_trial(i, found)
        return found

    with kept(train) as rows_in, ThreadPoolExecutor(parallelism) as pool:
        results = list(pool.map(run, range(len(trials))))
    finite = lambda m: m.get(primary) is not None and math.isfinite(m[primary])
    if not any(map(finite, results)):
        raise ValueError(f"no trial of {spec.name} has a finite {primary}")
    rows = [
        (spec.name, i, {k: float(v) for k, v in o.items()}, m, m.get(primary), "COMPLETE" if finite(m) else "FAIL")
        for i, (o, m) in enumerate(zip(trials, results))
    ]
    return train.sparkSession.createDataFrame(rows, TRIAL_SCHEMA)
