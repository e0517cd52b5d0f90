from __future__ import annotations

import gzip
import json
import os
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import LessThan, LessThanOrEqual

from slotwise.functions import formats
from slotwise.operators import drift, labels
from slotwise.operators import requests as req
from slotwise.plans import analysis, compare, sequential
from slotwise.sources import archive as archive_source
from slotwise.sources import trace as src
from slotwise.streaming import gaps, slots


def log_of(spark, values, variant="a", capacity=4):
    return spark.createDataFrame([(variant, capacity, i + 1, float(v)) for i, v in enumerate(values)], "variant string, capacity long, slot int, hr double")


def test_events_are_picked_greedily(spark):
    signal = np.array([9, 1, 1, 1, 1, 5, 8, 1, 1, 1, 7, 1, 1, 1, 1, 1, 1, 1, 1, 9], dtype=float)
    picked = lambda values, *args: [r.event - 1 for r in analysis.pick_events(log_of(spark, values), "hr", *args).collect()]
    assert picked(signal, 2, 3, 8, 3) == [6, 10, 16, 2]  # the ends lack room, 5 is too near to 6, of equal ones the later first
    assert picked(signal, 2, 3, 1, 3) == [6] and picked([float("nan")] * 20, 1, 1) == []
    found = {r.offset: r.mean for r in analysis.event_study(log_of(spark, signal), "hr", before=1, after=2, most=2).collect()}
    assert found == {-1: 3.0, 0: 7.5, 1: 1.0, 2: 1.0}


def test_weight_changes_by_hand(spark):
    rows = [(1, 1, 2.0), (2, 1, 1.0), (2, 2, 3.0), (3, 2, 0.0), (3, 3, 4.0)]
    got = {r.slot: r for r in analysis.weight_changes(spark.createDataFrame(rows, "slot int, created int, weight double")).collect()}
    assert got[1].l1_change is None and got[2].l1_change == pytest.approx(0.75 + 0.75) and got[3].l1_change == pytest.approx(0.25 + 0.25)
    assert got[3].frozen == 0.5 and got[2].mean == 2 and got[2].deviation == 1


def test_bootstrap_of_a_constant_gain(spark):
    base = [0.1 * (i % 5) for i in range(40)]
    both = log_of(spark, base, "a").unionByName(log_of(spark, [x + 0.05 for x in base], "b"))
    r = analysis.bootstrap_gain(both, "b", "a").first()
    assert (r.n_slots, round(r.delta, 9), round(r.delta_low, 9), round(r.delta_high, 9)) == (40, 0.05, 0.05, 0.05)
    assert r.rmr == pytest.approx(0.05 / 0.8) and r.rmr_low <= r.rmr <= r.rmr_high


def test_best_of_all_and_shift(spark):
    runs = spark.createDataFrame([("a", 4, 0.2), ("b", 4, 0.3), ("a", 9, 0.5), ("b", 9, 0.4), ("c", 9, 0.5)], "variant string, capacity long, hit_ratio double")
    assert sorted((r.capacity, r.variant) for r in analysis.best_variants(runs).collect()) == [(4, "b"), (9, "a")]
    assert [tuple(r) for r in analysis.best_variants(runs, None).collect()] == [("c", 0.5)]
    r = analysis.shift_miss_area(log_of(spark, [0.5, 0.25, 0.75, 1.0]), 2, 2).first()
    assert (r.n_slots, r.miss_area) == (2, 1.0)
    kept = {r.capacity: r.outcome for r in analysis.compare_by(runs.where("variant <> 'b' or capacity > 4"), ["capacity"], "a", "b", keep=True).collect()}
    assert kept == {4: "missing", 9: "win"}


def test_formats(spark):
    assert [formats.format_value(v) for v in (None, float("nan"), 0.123456789, 1e-9, 3, [0.5, 1], {"a": 0.25})] == ["NA", "NA", "0.123457", "1e-09", "3", "0.5, 1", "a=0.25"]
    assert formats.markdown_table(["a", "b"], [(1, 0.5)]) == "| a | b |\n| --- | --- |\n| 1 | 0.5 |"
    assert r"x\_1 & 50\%" in formats.latex_table(["x_1", "50%"], [(1, None)]) and "NA" in formats.latex_table(["x"], [(None,)])
    row = spark.range(1).withColumns(formats.decode_tag(formats.F.lit("gmn24_gmx221_sl2_sh61"))).withColumn("bad", formats.decode_tag(formats.F.lit("gmn24"))["gate_max"]).first()
    assert (row.gate_min, row.gate_max, row.spread_low, row.spread_high, row.bad) == (0.024, 0.221, 0.002, 0.061, None)


def test_sinks_and_conversions(spark, tmp_path):
    log = log_of(spark, [0.1, 0.2], "a").unionByName(log_of(spark, [0.3], "b"))
    src.write_slot_logs(log, str(tmp_path / "logs"))
    assert spark.read.json(str(tmp_path / "logs")).count() == 3 and (tmp_path / "logs/variant=a/capacity=4").exists()
    src.write_summary(log, str(tmp_path / "summary"))
    assert len(list((tmp_path / "summary").glob("*.json"))) == 1
    src.write_json_lines(log, str(tmp_path / "lines"))
    src.write_json_lines(log.limit(1), str(tmp_path / "lines"), append=True)
    assert spark.read.json(str(tmp_path / "lines")).count() == 4
    assert src.table_text(log.orderBy("variant", "slot").limit(1)) == "| variant | capacity | slot | hr |\n| --- | --- | --- | --- |\n| a | 4 | 1 | 0.1 |"
    assert "tabular" in src.table_text(log, "latex")
    runs = tmp_path / "runs"
    assert src.next_run_number(spark, str(runs)) == 1
    runs.mkdir()
    for name in ("001_a.json", "012_b.json", "x_13.json"):
        (runs / name).write_text(json.dumps({"model": name[4], "cache_size_objects": 4, "hit_ratio": 0.5}))
    assert src.next_run_number(spark, str(runs)) == 13
    assert {r.model for r in src.read_summaries(spark, str(runs / "0*.json")).collect()} == {"a", "b"}
    text = tmp_path / "t.gz"
    text.write_bytes(gzip.compress(b"1 10.5 http://a/A -\nbad line\n2 11.5 http://a/B - x\n3 12.5 http://a/C save\n"))
    assert src.count_lines(spark, str(text)) == 4 and src.header_reasons("1 10.5 x -") == [] and src.header_reasons("id 1.5") == ["unique_id is not a number"] and src.header_reasons(None)
    src.convert_lines(spark, str(text), str(tmp_path / "cut"), 3)
    assert [r.value for r in spark.read.text(str(tmp_path / "cut")).collect()] == ["1 10.5 http://a/A -", "bad line", "2 11.5 http://a/B - x"]
    src.convert_web_trace(spark, str(text), str(tmp_path / "web"), rows=2)
    found = src.validate_parquet(spark, str(tmp_path / "web"), 1)
    assert found["valid"] and (found["rows"], found["objects"], len(found["samples"])) == (3, 3, 1)
    assert [r.object_id for r in src.read_trace(spark, str(tmp_path / "web")).orderBy("seq").collect()] == ["http://a/A", "http://a/B", "http://a/C"]
    log.write.parquet(str(tmp_path / "other"))
    assert src.validate_parquet(spark, str(tmp_path / "other"))["unknown"] == ["capacity", "hr", "slot", "variant"]


def test_numbers_of_sparse_ids(spark, monkeypatch):
    monkeypatch.setattr(src, "STRETCH", 7)
    rng = random.Random(3)
    ids = rng.sample(range(-(10**15), 10**15), 100) + list(range(50))
    got = src.number_rows(spark.createDataFrame([(i,) for i in ids], "id long"), "id").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.seq)] == sorted(ids) and sorted(r.seq for r in got) == list(range(150))
    assert src.number_rows(spark.createDataFrame([], "id long"), "id").count() == 0


def test_budget_sizes(spark):
    n = labels.F.col("n")
    rows = spark.createDataFrame([(0,), (1,), (10,), (1000,)], "n int").select("n", labels.budget_size(n, 0.05).alias("a"), labels.budget_size(n, 20).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(0, 0), (1, 1), (1, 10), (50, 20)]


def stream(spark, tmp_path, rows, schema, files=4):
    """rows as a stream of several batches."""
    folder = tmp_path / "in"
    folder.mkdir()
    step = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * step : (i + 1) * step]
        (folder / f"{i}.json").write_text("\n".join(json.dumps(dict(zip([c.split()[0] for c in schema.split(", ")], r))) for r in part))
        os.utime(folder / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(folder))


def drain(df, tmp_path, name):
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return df.sparkSession.table(name).collect()


def test_streamed_gaps_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"o{rng.randrange(6)}", float(i + rng.random())) for i in range(80)]
    schema = "seq long, object_id string, ts double"
    got = drain(gaps.streaming_gaps(stream(spark, tmp_path, rows, schema), 3), tmp_path, "streamed_gaps")
    want = req.with_gaps(spark.createDataFrame(rows, schema), 3).collect()
    assert sorted((r.seq, r.g1, r.g2, r.g3) for r in got) == sorted((r.seq, r.g1, r.g2, r.g3) for r in want)


def test_streamed_slots_and_clamp_equal_the_batch(spark, tmp_path):
    """Over several batches and a restart from the checkpoint; batches that are run again, whole or after having failed half way, change nothing."""
    rng = random.Random(9)
    rows = [(i, f"o{i % 5}", None if rng.random() < 0.2 else float(rng.randint(0, 60))) for i in range(70)]
    columns, path = "place long, object_id string, raw_ts double", str(tmp_path / "out")
    requests = stream(spark, tmp_path, rows, columns)
    late = tmp_path / "in" / "3.json"
    late.rename(tmp_path / "3.json")
    slots.write_slots(requests, path, 8).awaitTermination()
    (tmp_path / "3.json").rename(late)
    slots.write_slots(requests, path, 8).awaitTermination()
    batch = src.with_slots(spark.createDataFrame([(i, o, t) for i, o, t in rows], "seq long, object_id string, raw_ts double"), 8)
    want = sorted((r.seq, r.slot, r.object_id, r.ts) for r in req.clamp_time(batch).collect())
    found = lambda: sorted((r.seq, r.slot, r.object_id, r.ts) for r in slots.read_slots(spark, path, columns).collect())
    assert found() == want and len(want) == 70
    again = spark.createDataFrame(rows[18:36], columns)
    slots.slot_batch(again, 1, path, 8)
    (tmp_path / "out/slots/batch=1/slot=4/part-left-over.json").write_text('{"place":1,"seq":1,"ts":1.0}')  # of a try that failed
    slots.slot_batch(again, 1, path, 8)
    assert found() == want


def test_hot_object_is_looked_at_in_stretches(spark):
    """An object with nine tenths of the requests: the same gaps whatever the stretch, and no window over more than a stretch of it."""
    rng = random.Random(6)
    rows = [(i, float(i) + rng.random(), "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])) for i in range(400)]
    trace = spark.createDataFrame(rows, "seq long, ts double, object_id string").repartition(3)
    whole = sorted(map(str, req.with_gaps(trace, stretch=10**9).collect()))
    for stretch in (1, 7, 50):
        assert sorted(map(str, req.with_gaps(trace, stretch=stretch).collect())) == whole
    seen: dict = {}
    for seq, ts, o in rows:
        seen.setdefault(o, []).append(ts)
    first = {r.seq: r for r in req.with_gaps(trace, stretch=50).collect()}
    past: dict = {}
    for seq, ts, o in rows:
        history = past.setdefault(o, [])
        assert [first[seq][f"g{i}"] for i in range(1, 7)] == [ts - history[-i] if len(history) >= i else req.SENTINEL for i in range(1, 7)] and first[seq].hist_len == min(6, len(history))
        history.append(ts)


def test_archives_of_a_folder(spark, tmp_path):
    """Two archives by a URI, numbered on in order of their names, each a partition; a bound ends the reading."""
    for name, lines in (("b", [b"5 x 10", b"bad", b"6 y 11"]), ("a", [b"%d k%d 1" % (i, i) for i in range(25)])):
        (tmp_path / "m.tr").write_bytes(b"\n".join(lines) + b"\n")
        with tarfile.open(tmp_path / f"{name}.tar.gz", "w:gz") as archive:
            archive.add(tmp_path / "m.tr", "m.tr")
    got = src.read_sized_archive(spark, tmp_path.as_uri()).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(27)) and [r.object_id for r in got[-2:]] == ["x", "y"] and got[3].timestamp == 3.0
    assert src.read_sized_archive(spark, str(tmp_path / "a.tar.gz"), 4).count() == 4
    source = archive_source.ArchiveReader(str(tmp_path), -1)
    assert len(source.partitions()) == 2
    left = list(source.pushFilters([LessThan(("seq",), 3), LessThanOrEqual(("size",), 5)]))
    assert [f.attribute for f in left] == [("size",)] and sum(b.num_rows for p in source.partitions() for b in source.read(p)) == 5
    assert spark.read.format("sized_archive").option("path", str(tmp_path)).load().rdd.getNumPartitions() == 2


def test_one_outlier_leaves_no_full_stretch(spark, monkeypatch):
    monkeypatch.setattr(src, "STRETCH", 16)
    ids = [*range(200), 10**15]
    numbered = src.number_rows(spark.createDataFrame([(i,) for i in ids], "id long"), "id")
    assert sorted(map(tuple, numbered.collect())) == [(i, n) for n, i in enumerate(ids)]


def test_bottom_k_is_combined_in_tasks(spark):
    """A sample, and the top objects, of a slot: tasks send k rows a slot, which the plan shows as a limit before the exchange."""
    objects = spark.range(1000).selectExpr("cast(id % 2 as int) as slot", "cast(id as string) as object_id", "id as freq", "id as first_seq")
    for df in (labels.sample_objects(objects, 5), labels.top_objects(objects, 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 10 and plan.count("WindowGroupLimit") == 2 and plan.rindex("Partial") > plan.rindex("Exchange")


def test_pairs_of_constants_have_no_correlation(spark):
    pairs = spark.createDataFrame([(1, 1.0, float(i)) for i in range(5)] + [(2, float(i), float(i)) for i in range(5)], "slot int, x double, y double")
    assert {r.slot: (r.pearson, r.spearman) for r in labels.correlations(pairs, "x", "y").collect()} == {1: (None, None), 2: (1.0, 1.0)}


def test_sequential_scores_equal_the_detectors(spark):
    """Native folds against the classes that take one value at a time, on a series that drifts, and on two runs at once."""
    rng = random.Random(8)
    series = [0.2 + 0.05 * rng.random() + (0.4 if 40 <= i < 70 else 0.0) for i in range(90)]
    log = log_of(spark, series).unionByName(log_of(spark, series[::-1], "b")).repartition(4)
    makers = [(sequential.drift_scores, drift.DriftScore), (sequential.one_sided_scores, drift.OneSidedDrift), (sequential.page_hinkley, drift.PageHinkley), (sequential.adaptive_window_scores, drift.AdaptiveWindow)]
    for native, plain in makers:
        got = {(r.variant, r.slot): r.score for r in native(log, "hr", ["variant"]).collect()}
        for variant, values in (("a", series), ("b", series[::-1])):
            one = plain()
            assert [got[variant, i + 1] for i in range(90)] == pytest.approx([one.update(v) for v in values], abs=1e-9), plain
    plan = sequential.drift_scores(log, "hr", ["variant"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_bootstrap_draws_blocks(spark):
    """Each draw is made of whole blocks of neighbours; draws are the same for all columns and at every run."""
    log = log_of(spark, range(10)).withColumn("twice", F.col("hr") * 2)
    drawn = compare.resampled(log, ["hr", "twice"], ["variant"], block=5, draws=50)
    rows = drawn.collect()
    assert len(rows) == 50 and all(r.twice == 2 * r.hr for r in rows) and len({r.hr for r in rows}) > 5
    assert all((r.hr - 2) * 2 == int((r.hr - 2) * 2) for r in rows)  # the mean of two blocks i..i+4 and j..j+4 is (i + j) / 2 + 2
    assert sorted(map(str, rows)) == sorted(map(str, drawn.collect()))
    short = compare.bootstrap_interval(log.where("slot <= 2"), "hr", "variant", block=5, draws=5).first()
    assert (short.low, short.high) == (0.5, 0.5)  # a series shorter than a block is the only block
