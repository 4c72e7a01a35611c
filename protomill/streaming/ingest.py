"""Resumable ingest: each id is kept once, and re-parsed rows move from rejected to parsed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from protomill.sources.files import shared_folder


def ingest_once(stream: DataFrame, id_col: str, path: str, checkpoint: str, time_col: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Appends each id's first row to Parquet, whatever the number of overlapping inputs, and ends when the input is used up.

    With a time column the ids seen are forgotten after ``delay``, so the state stays bounded; without one it holds all ids.
    """
    rows = stream.where(F.col(id_col).isNotNull())
    once = rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col]) if time_col else rows.dropDuplicates([id_col])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def saved_in_batches(stream: DataFrame, save: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch to ``save``, which may write to several sinks."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            save(batch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def promote(rejected: DataFrame, reparsed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append to parsed, rows that stay rejected): ``reparsed`` has qc_pass and replaces its rejected rows."""
    passed = reparsed.where("qc_pass")
    stays = rejected.join(reparsed.select(key), key, "left_anti").unionByName(reparsed.where("not qc_pass"), allowMissingColumns=True)
    return passed, stays


def call_model(items: DataFrame, prompt_col: str, call: Callable[[str], str], tries: int = 3, at_once: int = 8, in_flight: int = 4, order_col: str | None = None) -> DataFrame:
    """``items`` with reply and error, from a function of the prompt; a failure becomes an error and not an exception.

    ``at_once`` partitions with ``in_flight`` threads each bound how many calls run side by side.  Rows leave a task as their calls end; with ``order_col``, a column
    that numbers them, the result is put back in its order.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes) + ", reply string, error string"

    def one(prompt: str) -> tuple[str | None, str | None]:
        error = None
        for _ in range(tries):
            try:
                return call(prompt), None
            except Exception as e:  # any failure of a model is a row's result
                error = f"{type(e).__name__}: {e}"
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for pdf in batches:
                rows, flying = iter(range(len(pdf))), {}

                def start(n: int, pdf: pd.DataFrame = pdf, rows: Iterator[int] = rows, flying: dict = flying) -> None:
                    for at in islice(rows, n):
                        flying[pool.submit(one, pdf[prompt_col].iat[at])] = at

                start(in_flight)
                while flying:
                    ended = wait(flying, return_when=FIRST_COMPLETED).done
                    start(len(ended))
                    places = [flying.pop(f) for f in ended]
                    found = [f.result() for f in ended]
                    yield pdf.iloc[places].assign(reply=[f[0] for f in found], error=[f[1] for f in found])

    out = items.repartition(at_once).mapInPandas(run, schema)
    return out.repartitionByRange(order_col).sortWithinPartitions(order_col) if order_col else out


class CallsFailed(RuntimeError):
    """Some calls failed, after all were made."""


def call_all(items: DataFrame, prompt_col: str, call: Callable[[str], str], policy: str = "record", tries: int = 3, at_once: int = 8, in_flight: int = 4) -> DataFrame:
    """As call_model(), with a policy for calls that fail.

    ``record`` keeps failures as rows.  ``collect`` makes all calls, whose results are stored, and raises CallsFailed with the reasons if any failed.  ``abort`` lets the first failure
    end its task, and with it the job (after the cluster's retries of a task): no further rows are called for.
    """
    called = call_model(items, prompt_col, call, tries, at_once, in_flight)
    if policy == "record":
        return called
    if policy == "abort":
        return called.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")))
    if policy != "collect":
        raise ValueError(f"no such policy: {policy}")
    path = shared_folder(items.sparkSession, "calls")
    called.write.parquet(path)
    done = items.sparkSession.read.schema(called.schema).parquet(path)
    all_, failed = done.agg(F.count("*"), F.count("error")).first()
    if failed:
        reasons = [r[0] for r in done.where("error is not null").groupBy("error").count().orderBy(F.desc("count"), "error").limit(20).collect()]
        raise CallsFailed(f"{failed} of {all_} calls failed: {'; '.join(reasons)}")
    return done


def session(name: str = "protomill") -> SparkSession:
    """The active session, or a new one with adaptive execution and UTC."""
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
