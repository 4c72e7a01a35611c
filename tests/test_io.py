"""Sources, sinks and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from protomill.operators import records as R
from protomill.sources import files, paged
from protomill.streaming import ingest


def test_lines(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.strict_lines(spark, str(good), "a int").count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n{"a": \n')
    assert [r["a"] for r in files.tolerant_lines(spark, str(bad), "a int").collect()] == [1]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.strict_lines(spark, str(bad), "a int").collect()


def test_whole_file_pages_and_listing(spark, tmp_path):
    (tmp_path / "all.json").write_text(json.dumps([{"entries": [{"entry_id": "e", "views": {"top": "t.png", "left": "l.png"}}]}]))
    manifest = files.whole_file(spark, str(tmp_path / "all.json"), "entries array<struct<entry_id:string,views:map<string,string>>>")
    assert {tuple(r) for r in files.entry_views(manifest).collect()} == {("e", "top", "t.png"), ("e", "left", "l.png")}
    (tmp_path / "PMC1.xml").write_text("<a>\nb</a>")
    assert [tuple(r) for r in files.pages(spark, str(tmp_path)).collect()] == [("PMC1", "<a>\nb</a>")]
    assert {r["name"] for r in files.listing(spark, str(tmp_path)).collect()} >= {"PMC1.xml", "all.json"}


def test_routed_save(spark, tmp_path):
    df = spark.createDataFrame([(1, True, "a"), (2, False, "a"), (3, True, "b")], "id int, qc_pass boolean, source string")
    files.save_routed(df, str(tmp_path / "out"), ["id", "source", "qc_pass"])
    assert spark.read.json(str(tmp_path / "out/records")).where("qc_pass = 'true'").count() == 2
    assert spark.read.json(str(tmp_path / "out/manifest")).count() == 3


def test_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, source string").write.partitionBy("source").parquet(path)
    files.replace_partitions(spark.createDataFrame([(9, "a")], "id int, source string"), path, ["source"])
    assert {tuple(r) for r in spark.read.parquet(path).select("id", "source").collect()} == {(9, "a"), (2, "b")}


def pages(query):
    data = {"*": ([(query, 1), (query, 2)], "c1"), "c1": ([(query, 3)], "c2"), "c2": ([], None)}
    return lambda cursor: data[cursor]


def test_paged_source(spark):
    spark.dataSource.register(paged.paged_source("paged_test", "q string, n int", pages))
    got = spark.read.format("paged_test").option("queries", "x\ny").load()
    assert got.count() == 6 and got.where("q = 'y'").agg(F.sum("n")).first()[0] == 6


def three_pages(flag):
    """Fetches pages {1,2} {3,4} {5}, the last without a next cursor; the second fails while the flag's file is there."""

    def fetch_for(query):
        import os

        data = {"*": ([(query, 1), (query, 2)], "c1"), "c1": ([(query, 3), (query, 4)], "c2"), "c2": ([(query, 5)], None)}

        def fetch(cursor):
            if cursor == "c1" and os.path.exists(flag):
                raise OSError("down")
            return data[cursor]

        return fetch

    return fetch_for


def test_a_stream_gives_each_row_once_and_the_last_page_over_a_restart(spark, tmp_path):
    flag, out, state = (str(tmp_path / n) for n in ("down", "out", "state"))
    spark.dataSource.register(paged.paged_source("paged_stream", "q string, n int", three_pages(flag)))

    def run():
        q = spark.readStream.format("paged_stream").option("queries", "x\ny").load().writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    open(flag, "w").close()
    with pytest.raises(Exception, match="down"):
        run()
    (tmp_path / "down").unlink()
    run()
    assert sorted((r["q"], r["n"]) for r in spark.read.parquet(out).collect()) == [(q, n) for q in "xy" for n in range(1, 6)]
    run()  # nothing is left
    assert spark.read.parquet(out).count() == 10


def stream(data, queries=("q",), limit=None):
    return paged._Stream(list(queries), lambda q: lambda cursor: data[cursor], limit, None)


def drained(reader):
    at, out, offsets = reader.initialOffset(), [], []
    for _ in range(50):
        rows, end = reader.read(at)
        rows = list(rows)
        assert rows == list(reader.readBetweenOffsets(at, end))
        if not rows:
            return out, offsets
        assert end != at
        out, offsets, at = out + rows, [*offsets, end], end
    raise AssertionError("no end")


def test_offsets_of_a_stream():
    three = {"*": ([1, 2], "a"), "a": ([3], "b"), "b": ([4], None)}
    assert drained(stream(three))[0] == [1, 2, 3, 4]
    assert drained(stream(three, ("p", "q")))[0] == [1, 2, 3, 4] * 2
    assert drained(stream(three, limit=3))[0] == [1, 2, 3]
    assert drained(stream({"*": ([1], "a"), "a": ([], "b")}))[0] == [1]  # an empty page ends a query
    assert drained(stream({"*": ([], None)}))[0] == []
    assert drained(stream({"*": ([1], "*")}))[0] == [1]
    looped, offsets = drained(stream({"*": ([0], "a"), "a": ([1], "b"), "b": ([2], "c"), "c": ([3], "a")}))
    assert set(looped) == {0, 1, 2, 3} and len(offsets) < 12  # a loop of cursors ends


def test_a_rate_is_shared_by_partitions():
    now = [0.0]
    calls = []

    def sleep(seconds):
        now[0] += seconds

    both = [paged.Throttle(4.0, 2, lambda: now[0], sleep) for _ in range(2)]
    for _ in range(10):
        for t in both:
            t.wait()
            calls.append(now[0])
    assert calls[-1] >= 4.5 - 1e-9  # ten rounds, each partition half a second apart: four a second together
    free = paged.Throttle(None, 3, lambda: now[0], lambda s: pytest.fail("no rate, no wait"))
    free.wait()
    free.wait()


def test_walk_stops():
    assert list(paged.walk(pages("q"), limit=2)) == [("q", 1), ("q", 2)]
    loop = lambda cursor: ([(cursor,)], "a")
    assert list(paged.walk(loop, "a")) == [("a",)]


def test_patience():
    class Busy(Exception):
        code = 429

    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise Busy
        return "done"

    waits = []
    assert paged.patiently(call, sleep=waits.append) == "done"
    assert len(waits) == 2 and waits[1] >= 2


def test_each_id_is_kept_once_over_restarts(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id string, v int"
    for batch in ([("a", 1), ("b", 1)], [("a", 2), ("c", 2)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        ingest.ingest_once(stream, "id", out, state).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_micro_batches_to_several_sinks(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([("a", 1)], "id string, v int").write.json(source)

    def save(batch):
        batch.write.mode("append").json(str(tmp_path / "one"))
        batch.select("id").write.mode("append").json(str(tmp_path / "two"))

    ingest.saved_in_batches(spark.readStream.schema("id string, v int").json(source), save, state).awaitTermination()
    assert spark.read.json(str(tmp_path / "two")).count() == 1


def test_promote_and_upsert(spark):
    rejected = spark.createDataFrame([("a", False), ("b", False)], "id string, qc_pass boolean")
    again = spark.createDataFrame([("a", True)], "id string, qc_pass boolean")
    passed, stays = ingest.promote(rejected, again, "id")
    assert [r["id"] for r in passed.collect()] == ["a"] and [r["id"] for r in stays.collect()] == ["b"]
    manifest = spark.createDataFrame([("a", False), ("a", False), ("c", True)], "id string, qc_pass boolean")
    got = R.upsert(manifest, again, "id", ["qc_pass"]).collect()
    assert sorted(tuple(r) for r in got) == [("a", True), ("a", True), ("c", True)]


def test_model_failures_are_rows(spark):
    def call(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    df = spark.createDataFrame([("ok",), ("bad",)], "p string")
    got = {r["p"]: (r["reply"], r["error"]) for r in ingest.call_model(df, "p", call, tries=1, at_once=2).collect()}
    assert got == {"ok": ("OK", None), "bad": (None, "ValueError: no")}


def test_calls_run_side_by_side_within_bounds_and_come_back_in_order(spark, tmp_path):
    folder = str(tmp_path)

    def call(prompt):
        import os
        import time
        import uuid

        mine = f"{folder}/{uuid.uuid4().hex}.flying"
        open(mine, "w").close()
        flying = sum(f.endswith(".flying") for f in os.listdir(folder))
        time.sleep(0.02 * (int(prompt) % 4))
        os.remove(mine)
        return f"{prompt}/{flying}"

    df = spark.createDataFrame([(i, str(i)) for i in range(40)], "n int, p string")
    got = ingest.call_model(df, "p", call, at_once=1, in_flight=3, order_col="n").collect()
    assert [r["reply"].split("/")[0] for r in got] == [str(i) for i in range(40)]
    together = [int(r["reply"].split("/")[1]) for r in got]
    assert max(together) <= 3 and max(together) > 1


def manifest_of(spark, tmp_path, **options):
    from protomill.sources.manifest import Manifest

    return Manifest(spark, str(tmp_path / "m"), "id", **options)


def saved(m):
    rows = m.rows()
    return sorted((r["id"], r["v"]) for r in rows.collect()) if rows is not None else []


def test_a_crash_between_staging_and_commit_loses_and_repeats_nothing(spark, tmp_path):
    m, df = manifest_of(spark, tmp_path), spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "x")], "id int, v string")

    def crash():
        raise KeyboardInterrupt

    assert saved(m) == []
    with pytest.raises(KeyboardInterrupt):
        m.save(df, crash)
    assert saved(m) == []
    assert m.save(df) == 2 and m.save(df) == 0
    assert saved(m) == [(1, "a"), (2, "b")]
    assert m.clean() == 2 and saved(m) == [(1, "a"), (2, "b")]


def test_overlapping_writers_save_no_id_twice(spark, tmp_path):
    m, other = manifest_of(spark, tmp_path), manifest_of(spark, tmp_path)
    mine, theirs = (spark.createDataFrame(rows, "id int, v string") for rows in ([(1, "m"), (2, "m")], [(2, "t"), (3, "t")]))
    turn = []

    def meanwhile():
        if not turn:
            turn.append(1)
            assert other.save(theirs) == 2

    assert m.save(mine, meanwhile) == 1
    assert saved(m) == [(1, "m"), (2, "t"), (3, "t")] and len(m.commits()) == 2


def test_an_empty_commit_is_void(spark, tmp_path):
    m = manifest_of(spark, tmp_path, lease=0.0)
    (tmp_path / "m" / "commits").mkdir(parents=True)
    (tmp_path / "m" / "commits" / "0000000001").touch()
    assert m.save(spark.createDataFrame([(1, "a")], "id int, v string")) == 1
    assert saved(m) == [(1, "a")] and (tmp_path / "m" / "commits" / "0000000002").exists()


def test_a_cache_is_read_through(spark, tmp_path):
    from protomill.sources.manifest import read_through

    folder, asked = str(tmp_path / "cache"), tmp_path / "asked"
    asked.mkdir()

    def fetch(key):
        import uuid

        open(f"{asked}/{key}.{uuid.uuid4().hex}", "w").close()
        return None if key == "none" else f"text of {key}"

    want = spark.createDataFrame([("a",), ("b",), ("b",), ("none",), (None,)], "k string")
    run = lambda: {r["k"]: r["text"] for r in read_through(want, "k", folder, fetch, 2).collect()}
    names = lambda: sorted(f.name.split(".")[0] for f in asked.iterdir())
    assert run() == {"a": "text of a", "b": "text of b", "none": None} and names() == ["a", "b", "none"]
    assert run() == {"a": "text of a", "b": "text of b", "none": None} and names() == ["a", "b", "none", "none"]
    torn = [f for f in (tmp_path / "cache").glob("part-*") if f.stat().st_size > 600]
    for f in torn:
        f.write_bytes(f.read_bytes()[:100])
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert torn and run() == {"a": "text of a", "b": "text of b", "none": None}
    assert names().count("a") + names().count("b") > 2


def test_failure_policies(spark):
    def call(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt

    df = spark.createDataFrame([("ok",), ("bad",), ("bad",)], "p string")
    assert ingest.call_all(df, "p", call, "record").where("error is not null").count() == 2
    with pytest.raises(ingest.CallsFailed, match=r"2 of 3 .*ValueError: no"):
        ingest.call_all(df, "p", call, "collect")
    with pytest.raises(Exception, match="ValueError: no"):
        ingest.call_all(df, "p", call, "abort").collect()
    assert ingest.call_all(df.where("p = 'ok'"), "p", call, "collect").count() == 1
