"""Progressive runs: batches of growing size whose summaries merge into those of one large run."""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import MASK
from ..operators.simulate import Simulation, as_sheets, column_name, compare_samples, iterations, run_compiled, simulation
from ..operators.storage import kept
from ..operators.summary import FIRST_BATCH, bin_of, binned, bins_of, long_samples, merge_bins, place_bins, place_late, summaries_of, with_places
from ..plans.compiler import compile_sheets

#: A batch has at most this many iterations.
LARGEST_BATCH = 4_194_304
#: Iterations that count in the histogram beside the moments, unless a run wants all; later ones count in the moments only.
BINNED = 262_144
#: Iterations over which two engines are held against each other, one by one.
COMPARED = 100_000
#: Batches that are under way at once: one runs while the next is queued.
AHEAD = 2

Progress = Callable[[int, DataFrame], bool | None]


def batches(count: int, first: int = FIRST_BATCH, most: int = LARGEST_BATCH, cut: int | None = None) -> Iterator[tuple[int, int]]:
    """(start, size): contiguous, doubling from the first size up to the most; none reaches over the cut."""
    start, size = 0, min(first, most)
    while start < count:
        now = min(size, count - start)
        if cut is not None and start < cut:
            now = min(now, cut - start)
        yield start, now
        start, size = start + now, min(2 * size, most)


class _Jobs:
    """Jobs of one run, in threads of their own with the run's tags and pool: all can be stopped at once."""

    def __init__(self, session: SparkSession, tags: list[str], pool: str = "sheetstorm"):
        self.session, self.tags, self.pool = session, tags, pool
        self.threads = ThreadPoolExecutor(AHEAD)

    def submit(self, job: Callable, *args) -> Future:
        def run():
            # Under a fair scheduler jobs of this pool share the cores; under the usual one they queue.
            self.session.sparkContext.setLocalProperty("spark.scheduler.pool", self.pool)
            for tag in self.tags:
                self.session.sparkContext.addJobTag(tag)
            return job(*args)

        return self.threads.submit(inheritable_thread_target(self.session)(run))

    def stop(self) -> None:
        self.session.sparkContext.cancelJobsWithTag(self.tags[0])
        self.threads.shutdown(wait=True, cancel_futures=True)

    def close(self) -> None:
        self.threads.shutdown(wait=True)


class State:
    """What a run has seen: the stored bin tables of its batches, merged when asked for. Rows per output are at most those of a bin table."""

    def __init__(self):
        self.parts: list[DataFrame] = []
        self.done = 0

    def add(self, part: DataFrame, done: int) -> None:
        self.parts.append(part)
        self.done = done

    def table(self) -> DataFrame:
        if len(self.parts) > 1:
            self.parts = [kept(merge_bins(reduce(lambda a, b: a.unionByName(b), self.parts), ["cell"]))]
        return self.parts[0]

    def summaries(self) -> DataFrame:
        return summaries_of(self.table(), ["cell"])

    def bins(self) -> DataFrame:
        return bins_of(self.table(), ["cell"])


def run_in_phases(run: Simulation, *, progress: Callable[[State], bool | None] | None = None, every_seconds: float = 0.2, first: int = FIRST_BATCH, binned_until: int | None = BINNED, tag: str | None = None) -> State:
    """Runs all ids of a simulation in batches, the next one queued while one runs; both kinds of result come from the same batches.

    The first FIRST_BATCH rows place the bins. Up to binned_until a batch is one job for histogram and moments; beyond,
    the histogram is sure enough, and a batch makes moments only, a row per output. Without it (None) all ids are binned. As draws are keyed by the
    iteration, moments are those of a single run. progress stops the run by False: what is under way is
    interrupted and dropped. With a tag, `sparkContext.cancelJobsWithTag(tag)` from another thread stops it with an error.
    """
    session, names = run.session, list(run.outputs)
    state, (origin, end) = State(), run.span()
    jobs = _Jobs(session, [f"run-{uuid.uuid4().hex}", *([tag] if tag else [])])
    places: DataFrame | None = None
    binned_until = end - origin if binned_until is None else binned_until

    def samples(start: int, size: int) -> DataFrame:
        return long_samples(run.samples(origin + start, origin + start + size), names)

    def batch(start: int, size: int) -> DataFrame:
        return kept(binned(with_places(samples(start, size), places, ["cell"]), ["cell"], moments_only=start >= binned_until))

    def place(count: int) -> DataFrame:
        found = kept(place_bins(samples(0, min(run.opening(FIRST_BATCH) - origin, binned_until, count)), ["cell"]))
        if not found.where("scale is null").isEmpty():  # nothing finite so far: look further
            late = place_late(samples(0, min(binned_until, count)), ["cell"]).join(found.where("scale is null").select("cell"), "cell")
            found = kept(found.where("scale is not null").unionByName(late))
        return found

    last, under_way = 0.0, deque()
    planned = batches(end - origin, first, cut=binned_until)

    def launch() -> None:
        for start, size in planned:
            under_way.append((start + size, jobs.submit(batch, start, size)))
            return

    try:
        if end > origin:  # bins rest on the first FIRST_BATCH rows, whatever the batches
            places = jobs.submit(place, end - origin).result()
        for _ in range(AHEAD):
            launch()
        while under_way:
            done, job = under_way.popleft()
            state.add(job.result(), done)
            launch()
            if progress and (time.monotonic() - last >= every_seconds or not under_way):
                last = time.monotonic()
                if progress(state) is False:
                    break
    except BaseException:
        jobs.stop()
        raise
    if under_way:
        jobs.stop()
        for _, job in under_way:
            with suppress(Exception):  # the stopped ones
                job.result()
    jobs.close()
    return state


def run_progressively(
    rows: SparkSession | DataFrame, model, outputs: list[str], count: int | None = None, *, seed: int = 1, progress: Progress | None = None, every_seconds: float = 0.2, first: int = FIRST_BATCH, tag: str | None = None, iteration: str = "iteration"
) -> DataFrame:
    """Summaries after all batches (see run_in_phases); progress gets (iterations done, summaries so far) now and then."""
    told = (lambda state: progress(state.done, state.summaries())) if progress else None
    return run_in_phases(simulation(rows, model, outputs, count, seed=seed, iteration=iteration), progress=told, every_seconds=every_seconds, first=first, tag=tag).summaries()


def histogram_progressively(
    rows: SparkSession | DataFrame, model, outputs: list[str], count: int | None = None, *, seed: int = 1, progress: Progress | None = None, first: int = FIRST_BATCH, tag: str | None = None, iteration: str = "iteration"
) -> DataFrame:
    """cell, bin, low, high, n of all iterations; progress gets (iterations done, bins so far) after each batch."""
    told = (lambda state: progress(state.done, state.bins())) if progress else None
    return run_in_phases(simulation(rows, model, outputs, count, seed=seed, iteration=iteration), progress=told, every_seconds=0, first=first, binned_until=None, tag=tag).bins()


@dataclass
class Compared:
    """Two engines' runs: how their samples differ so far, and what each of them has done."""

    session: SparkSession
    found: dict[str, tuple[int, float, int]]
    done: dict[str, int]
    share: float

    def comparison(self) -> DataFrame:
        """output, compared, worst, mismatches, allowed, agrees."""
        rows = [(o, *x, int(x[0] * self.share), x[2] <= int(x[0] * self.share)) for o, x in self.found.items()]
        return self.session.createDataFrame(rows, "output string, compared long, worst double, mismatches long, allowed long, agrees boolean")


def run_engines(run: Simulation, *, engines: tuple[str, str] = ("columns", "batches"), tolerance: float = 1e-4, share: float = 0.001, progress: Callable[[Compared], bool | None] | None = None, first: int = FIRST_BATCH, compared: int = COMPARED) -> Compared:
    """Both engines at once over the same batches, each in its thread; the samples of the first `compared` iterations are held against each other.

    Samples of a compared batch are stored until both engines have them. An engine that fails interrupts the
    other one by its tag, and its error is raised; progress stops both by False.
    """
    session, (origin, end) = run.session, run.span()
    upto = min(compared, end - origin)
    state = Compared(session, {}, dict.fromkeys(engines, 0), share)
    tags = {engine: f"engine-{engine}-{uuid.uuid4().hex}" for engine in engines}
    stored: dict[int, DataFrame] = {}
    stop, lock, failures = threading.Event(), threading.Lock(), []

    def halt(but: str | None = None) -> None:
        stop.set()
        for engine in engines:
            if engine != but:
                session.sparkContext.cancelJobsWithTag(tags[engine])

    def compare(start: int, table: DataFrame) -> None:
        with lock:
            other = stored.pop(start, None)
            if other is None:
                stored[start] = table
                return
        rows = compare_samples(table, other, list(run.outputs), tolerance=tolerance, share=share).collect()
        with lock:
            for r in rows:
                before = state.found.get(r["output"], (0, 0.0, 0))
                state.found[r["output"]] = (before[0] + r["compared"], max(before[1], r["worst"] or 0.0), before[2] + r["mismatches"])

    def work(engine: str) -> None:
        session.sparkContext.addJobTag(tags[engine])
        try:
            for start, size in batches(end - origin, first, cut=upto):
                if stop.is_set():
                    return
                samples = run.samples(origin + start, origin + start + size, engine=engine)
                if start < upto:
                    compare(start, kept(samples))
                else:
                    samples.write.format("noop").mode("overwrite").save()
                state.done[engine] = start + size
                if progress and not stop.is_set() and progress(state) is False:
                    halt()
        except Exception as error:
            if not stop.is_set():
                failures.append(error)
                halt(but=engine)

    threads = [threading.Thread(target=inheritable_thread_target(session)(work), args=(engine,)) for engine in engines]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    if failures:
        raise failures[0]
    return state


def compare_progressively(
    rows: SparkSession | DataFrame, model, outputs: list[str], count: int | None = None, *, seed: int = 1, tolerance: float = 1e-4, share: float = 0.001, progress: Progress | None = None, first: int = FIRST_BATCH, compared: int = COMPARED, iteration: str = "iteration"
) -> DataFrame:
    """The cross-check of both engines, batch by batch, over up to `compared` iterations: output, compared, worst, mismatches, allowed, agrees."""
    told = (lambda state: progress(min(state.done.values()), state.comparison())) if progress else None
    run = simulation(rows, model, outputs, count, seed=seed, iteration=iteration)
    return run_engines(run, tolerance=tolerance, share=share, progress=told, first=first, compared=compared).comparison()


def stream_iterations(spark: SparkSession, per_batch: int, parts: int = 2) -> DataFrame:
    """Iterations as a stream: the micro-batch source numbers its rows, whatever the trigger."""
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_batch).option("numPartitions", parts).load()
    return source.select(F.col("value").bitwiseAND(F.lit(MASK)).alias("iteration"))


def stream_histogram(spark: SparkSession, model, outputs: list[str], per_batch: int, *, seed: int = 1) -> DataFrame:
    """A streaming count per cell and histogram bin (complete mode): the state is at most 4,002 rows per output.

    The bins are those of the first FIRST_BATCH iterations, which are computed at once, as in a batch run.
    """
    compiled = compile_sheets(as_sheets(model))
    columns = {column_name(o): o for o in outputs}
    opening = long_samples(run_compiled(iterations(spark, FIRST_BATCH), compiled, columns, seed=seed), list(columns))
    places = {r["cell"]: (r["centre"], r["scale"]) for r in place_bins(opening, ["cell"]).collect()}
    samples = long_samples(run_compiled(stream_iterations(spark, per_batch), compiled, columns, seed=seed), list(columns))
    bins = None
    for cell, (centre, scale) in places.items():
        found = F.when(F.col("cell") == cell, bin_of(F.col("value"), F.lit(centre), F.lit(scale)))
        bins = found if bins is None else F.coalesce(bins, found)
    return samples.withColumn("bin", bins).groupBy("cell", "bin").agg(F.count(F.lit(1)).alias("n"))
