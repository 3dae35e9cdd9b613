"""Parameter search: spaces, samplers, the validation objective, resumable studies, and sweeps over catalog size."""

from __future__ import annotations

import functools
import logging
import math
import random
import resource
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import splits as P
from ..sources import sinks
from . import content
from .evaluate import SPACES, draw, evaluate
from .models import BiasedALS, Cascade, Hybrid, Model

log = logging.getLogger(__name__)

def _inner(params: dict, name: str) -> dict:
    return {k.partition(".")[2]: v for k, v in params.items() if k.startswith(name + ".")}


def build(name: str, params: dict, train: DataFrame, items: DataFrame) -> Model:
    """A fitted model of one of the four kinds from drawn parameters."""
    if name == "als":
        return replace(BiasedALS.fit(train, **{k: v for k, v in params.items() if k != "penalty"}), penalty=params.get("penalty", 0.0))
    if name == "content":
        return content.fit(items, train, content.Settings(**params))
    first, second = build("als", _inner(params, "als"), train, items), build("content", _inner(params, "content"), train, items)
    return Hybrid(first, second, params["alpha"]) if name == "hybrid" else Cascade(first, second, params["primary_k"])


def validation_score(model: Model, train: DataFrame, val: DataFrame, metric: str = "ndcg", k: int = 10, n_negatives: int = 99, most: int = 20, seed: int = 42) -> float:
    """One metric at k, each user's relevant items among n_negatives others; nothing to evaluate: 0."""
    rows = evaluate({"model": model}, train, val, ks=(k,), most=most, n_negatives=n_negatives, seed=seed).select(metric).collect()  # one row
    return float(rows[0][0] or 0.0) if rows else 0.0


def tpe(space: dict, rows: list[dict], rng: random.Random, startup: int = 10, draws: int = 24, share: float = 0.25) -> dict:
    """Parameters for the next trial: uniform draws first; then, of draws near good trials, the one likeliest among the best `share` and least likely among the others."""
    if len(rows) < startup:
        return draw(space, rng)
    ranked = sorted(rows, key=lambda r: (-r["value"], r["trial"]))
    cut = max(1, math.ceil(share * len(ranked)))
    good, rest = ranked[:cut], ranked[cut:] or ranked[:1]
    out = {}
    for name, bounds in space.items():
        if isinstance(bounds, list):
            weigh = lambda group, v: (1 + sum(r["params"][name] == v for r in group)) / (len(bounds) + len(group))  # noqa: E731, B023
            out[name] = max(rng.choices(bounds, [weigh(good, v) for v in bounds], k=draws), key=lambda v: weigh(good, v) / weigh(rest, v))
            continue
        low, high, *step = bounds
        scale = (lambda v: math.log(v)) if not step and low > 0 and high / low > 100 else float
        a, b = scale(low), scale(high)
        width = max((b - a) / max(2, len(good)), 1e-12)

        def density(group, x, a=a, b=b, width=width, name=name, scale=scale):
            return 1 / (b - a) + sum(math.exp(-(((x - scale(r["params"][name])) / width) ** 2) / 2) / width for r in group)

        xs = [min(b, max(a, rng.gauss(scale(rng.choice(good)["params"][name]), width))) for _ in range(draws)]
        x = max(xs, key=lambda x: density(good, x) / len(good) / (density(rest, x) / len(rest)))
        out[name] = low + step[0] * round((x - low) / step[0]) if step else min(high, max(low, math.exp(x))) if scale is not float else x
    return out


def study(spark: SparkSession, path: str, name: str, objective: Callable[[dict], float], space: dict, trials: int, seed: int = 42) -> list[dict]:
    """Runs the trials that the store lacks; each is appended as soon as it ends, so that a lost driver loses one trial. A failing trial is stored with its error and value 0."""
    rows = sinks.read_trials(spark, path, name)
    for t in range(len(rows), trials):
        params, error = tpe(space, rows, random.Random(f"{seed}/{name}/{t}")), None
        try:
            value = objective(params)
        except Exception as e:  # noqa: BLE001 - a trial may fail in any way
            log.warning("trial %d of %s failed: %s", t, name, e)
            value, error = 0.0, str(e)[:500]
        rows.append({"trial": t, "params": params, "value": value})
        sinks.append_trial(spark, path, name, t, params, value, error)
    return rows


def best_trials(trials: DataFrame) -> DataFrame:
    """(study, trial, value) of each study's best trial, the earliest of equal ones."""
    return trials.groupBy("study").agg(F.max(F.struct("value", (-F.col("trial")).alias("t"))).alias("b")).select("study", (-F.col("b.t")).alias("trial"), F.col("b.value").alias("value"))


def tune(ratings: DataFrame, items: DataFrame, store: str, params_path: str, trials: int | dict = 100, spaces: dict | None = None, names: tuple[str, ...] = ("als", "content", "hybrid", "cascade"), skip_saved: bool = False) -> dict:
    """Split, one study a model, best parameters merged into the JSON file; with skip_saved, models that the file holds are left."""
    spark, spaces = ratings.sparkSession, spaces or SPACES
    parts = C.checkpointed(P.tuning_split(ratings))
    train, val = parts.filter("split = 'train'"), parts.filter("split = 'val'")
    saved = sinks.read_params(params_path)
    for name in names:
        if skip_saved and name in saved:
            continue
        n = trials[name] if isinstance(trials, dict) else trials
        rows = study(spark, store, name, lambda p, name=name: validation_score(build(name, p, train, items), train, val), spaces[name], n)
        top = max(rows, key=lambda r: (r["value"], -r["trial"]))
        saved = sinks.upsert_params(params_path, name, top["params"], top["value"])
    return saved


def _ranks(rows: list[dict], goals: tuple[str, ...]) -> list[list[dict]]:
    """Fronts of rows that no row of the same or a later front beats."""
    beats = lambda a, b: all(a[g] >= b[g] for g in goals) and any(a[g] > b[g] for g in goals)
    left, fronts = list(rows), []
    while left:
        front = [r for r in left if not any(beats(o, r) for o in left)]
        fronts.append(front)
        left = [r for r in left if not any(r is f for f in front)]
    return fronts


def _spread(front: list[dict], goals: tuple[str, ...]) -> list[dict]:
    """A front from its least crowded rows to its most crowded ones."""
    room = {id(r): 0.0 for r in front}
    for g in goals:
        line = sorted(front, key=lambda r: r[g])
        span = line[-1][g] - line[0][g] or 1.0
        room[id(line[0])] = room[id(line[-1])] = math.inf
        for a, r, b in zip(line, line[1:], line[2:], strict=False):
            room[id(r)] += (b[g] - a[g]) / span
    return sorted(front, key=lambda r: -room[id(r)])


def evolve(objective: Callable[[dict], dict], space: dict[str, tuple], goals: tuple[str, ...] = ("map", "coverage"), population: int = 40, generations: int = 4, seed: int = 42, blend: float = 0.5, sigma: float = 0.03, mutate: float = 0.15) -> list[dict]:
    """The front after a genetic search by dominance and crowding; objective returns the goals. Genes cross by blending, mutate by noise of sigma of their range and stay in bounds."""
    rng = random.Random(seed)
    measured = lambda p: {"params": p} | objective(p)
    select = lambda rows: [r for f in _ranks(rows, goals) for r in _spread(f, goals)][:population]
    pool = select([measured(draw(space, rng)) for _ in range(population)])
    for _ in range(generations):
        children = []
        for _ in range(population):
            a, b = (pool[min(rng.randrange(len(pool)), rng.randrange(len(pool)))]["params"] for _ in "ab")  # a tournament of two on the sorted pool
            child = {}
            for name, (low, high, *step) in space.items():
                at = rng.uniform(-blend, 1 + blend)
                x = a[name] + at * (b[name] - a[name])
                x += rng.gauss(0, sigma * (high - low)) if rng.random() < mutate else 0.0
                x = min(high, max(low, x))
                child[name] = min(high, low + step[0] * round((x - low) / step[0])) if step else x
            children.append(measured(child))
        pool = select(pool + children)
    return _ranks(pool, goals)[0]


def catalog_sweep(ratings: DataFrame, fit: Callable[[DataFrame], dict[str, Model]], fractions: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0), seed: int = 42, **options) -> DataFrame:
    """evaluate() on nested hash samples of the items: each fraction's items hold those of the smaller ones."""
    out = None
    for f in fractions:
        mine = P.cold_start(P.leave_last_n(C.hash_sample(ratings, "item_id", f, seed)))
        train, test = mine.filter("split = 'train'"), mine.filter("split = 'test'")
        got = evaluate(fit(train), train, test, **options).withColumn("catalog_fraction", F.lit(f))
        out = got if out is None else out.unionByName(got)
    return out


def profiled(step: Callable) -> Callable:
    """Logs a driver step's wall and CPU seconds and its peak resident memory; executors are the Spark UI's."""

    @functools.wraps(step)
    def timed(*args, **kwargs):
        wall, cpu = time.perf_counter(), time.process_time()
        try:
            return step(*args, **kwargs)
        finally:
            log.info("%s: %.3f s, CPU %.3f s, peak %.1f MB", step.__name__, time.perf_counter() - wall, time.process_time() - cpu, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)

    return timed
