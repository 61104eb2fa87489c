"""Sweeps that run: each run's table is built once for all runs that need it, then the runs, several at a time.

Whatever is finished is found again by the digest of its settings, so a sweep that broke off goes on where it stopped. The
first failure cancels the jobs of the others by their tag and is raised.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.sources.store import exists, once

from .settings import digest, sweep


def plan(spark: SparkSession, path: str, fixed: Mapping, runs: Sequence[Mapping]) -> list[dict]:
    """Of each run: name, settings, and whether its table and its result are there. Settings have the parts features and train."""
    out = []
    for made in sweep(fixed, runs):
        settings = {k: v for k, v in made.items() if k != "name"}
        at = {"table": settings["features"], "result": settings}
        there = {f"{k}_exists": exists(spark, f"{path}/{k}/{digest(v)}/result/_SUCCESS") for k, v in at.items()}
        out.append({"name": made["name"], "settings": settings} | there)
    return out


def _together(spark: SparkSession, jobs: Mapping[str, Callable[[], object]], at_once: int) -> dict[str, object]:
    """The jobs' results by name; the first that fails cancels the others' Spark jobs and is raised."""
    tag = f"sweep-{uuid.uuid4().hex}"

    def run(job: Callable[[], object]):
        spark.addTag(tag)
        try:
            return job()
        finally:
            spark.removeTag(tag)

    with ThreadPoolExecutor(at_once) as pool:
        begun = {name: pool.submit(run, job) for name, job in jobs.items()}
        done, rest = wait(begun.values(), return_when=FIRST_EXCEPTION)
        failed = next((f for f in done if f.exception()), None)
        if failed is not None:
            for f in rest:
                f.cancel()
            spark.interruptTag(tag)
            wait(begun.values())
            raise failed.exception()
    return {name: f.result() for name, f in begun.items()}


def run(
    spark: SparkSession, path: str, fixed: Mapping, runs: Sequence[Mapping],
    table: Callable[[Mapping], DataFrame], rate: Callable[[DataFrame, Mapping], DataFrame], at_once: int = 4,
) -> DataFrame:
    """(name, ...): what `rate` gives for each run, which is called with the run's table and its training settings.

    table(features) builds the table for some feature settings. Both are built once for their settings, below `path`.
    """
    planned = plan(spark, path, fixed, runs)
    tables = {digest(p["settings"]["features"]): p["settings"]["features"] for p in planned}
    built = _together(spark, {name: (lambda f=f: once(spark, f"{path}/table", f, lambda: table(f))) for name, f in tables.items()}, at_once)
    jobs = {
        p["name"]: (lambda s=p["settings"]: once(spark, f"{path}/result", s, lambda: rate(built[digest(s["features"])], s["train"])))
        for p in planned
    }
    found = _together(spark, jobs, at_once)
    out = None
    for p in planned:
        own = found[p["name"]].select(F.lit(p["name"]).alias("name"), "*")
        out = own if out is None else out.unionByName(own)
    return out
