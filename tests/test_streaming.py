"""Drained streams against their batch counterparts, replays, late clicks and the dynamic blacklist."""

import datetime as dt
import json
import os
import shutil

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.operators import adclicks
from footfall.plans.ad_clicks import start_ad_clicks
from footfall.schemas import AD_CLICK
from footfall.sinks.changelog import BatchLog, ChangeLog
from footfall.sources import star
from footfall.sources.streams import read_parquet_stream, read_text_stream
from footfall.streaming import pipelines
from footfall.streaming.tables import AdTables

MINUTE = dt.timedelta(minutes=1)
T0 = dt.datetime(2024, 1, 5, 9, 0, 0, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def clicks(spark, sf_dir):
    log = star.ad_click_log(spark, sf_dir)
    return log.withColumn("ts", F.col("ts").cast("timestamp")).cache()


@pytest.fixture
def feed(spark, clicks, tmp_path):
    """The clicks as three files, in time order, read one file per micro-batch."""
    folder = str(tmp_path / "in")
    ordered = clicks.withColumn("part", F.ntile(3).over(_by_time()))
    for part in (1, 2, 3):
        _drop(ordered.where(F.col("part") == part).drop("part"), folder, f"part{part}.parquet", tmp_path)
    return read_parquet_stream(spark, folder, AD_CLICK, files_per_batch=1)


def _by_time():
    from pyspark.sql.window import Window

    return Window.orderBy("ts")


def _drop(df, folder, name, tmp_path):
    """One file with a name and a time stamp that keep the order of arrival."""
    staging = str(tmp_path / f"staging-{name}")
    df.coalesce(1).write.parquet(staging)
    os.makedirs(folder, exist_ok=True)
    source = next(f for f in os.listdir(staging) if f.endswith(".parquet"))
    target = os.path.join(folder, name)
    shutil.copy(os.path.join(staging, source), target)
    moment = 1_700_000_000 + 10 * len(os.listdir(folder))
    os.utime(target, (moment, moment))


def _same(one, other):
    columns = sorted(other.columns)
    return sorted(map(str, one.select(columns).collect())) == sorted(map(str, other.select(columns).collect()))


def test_statistics_and_ranking_equal_batch(spark, clicks, feed, tmp_path):
    tables = AdTables(str(tmp_path / "out"))
    query = pipelines.stat_stream(feed, tables)
    pipelines.drain(query, 300)
    batch = adclicks.ad_stat(clicks)
    assert _same(tables.stat.totals(spark), batch)
    assert _same(tables.province_top3(spark), adclicks.province_top_ads(batch))


def test_trend_equals_batch(spark, clicks, feed, tmp_path):
    tables = AdTables(str(tmp_path / "out"))
    pipelines.drain(pipelines.trend_stream(feed, tables), 300)
    assert _same(tables.trend.totals(spark), adclicks.click_trend(clicks))


def test_sliding_totals_equal_batch(spark, clicks, feed, tmp_path):
    tables = AdTables(str(tmp_path / "out"))
    pipelines.drain(pipelines.sliding_stream(feed, tables), 300)
    assert _same(tables.sliding_totals(spark), adclicks.sliding_totals(clicks))


def test_one_pass_over_panes_equals_direct_windows(clicks):
    direct = clicks.groupBy(F.window("ts", "60 minutes", "10 minutes").alias("w"), "ad_id").agg(
        F.count(F.lit(1)).alias("click_count")
    )
    direct = direct.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "ad_id", "click_count"
    )
    assert _same(adclicks.sliding_totals(clicks), direct)


def _expected_clean(batches, threshold):
    listed, counts, kept = set(), {}, []
    for batch in batches:
        for click in [c for c in batch if c[3] not in listed]:
            kept.append(click)
            key = (click[0].date(), click[3], click[4])
            counts[key] = counts.get(key, 0) + 1
        listed |= {user for (_, user, _), n in counts.items() if n >= threshold}
    return listed, counts, kept


def test_blacklist_grows_between_batches(spark, tmp_path):
    def click(minute, user, ad=1, city="c"):
        return (T0 + minute * MINUTE, "p", city, user, ad)

    batches = [
        [click(0, 1), click(0, 1), click(0, 2), click(1, 3, ad=1), click(1, 3, ad=2)],
        [click(2, 1), click(2, 2), click(2, 3, ad=1), click(2, 4)],
        [click(3, 1), click(3, 2), click(3, 3, ad=2), click(3, 4), click(3, 4, city="d")],
    ]
    folder = str(tmp_path / "in")
    for i, batch in enumerate(batches):
        _drop(spark.createDataFrame(batch, AD_CLICK), folder, f"b{i}.parquet", tmp_path)
    tables = AdTables(str(tmp_path / "out"), keep_clicks=True, fold_every=2)
    feed = read_parquet_stream(spark, folder, AD_CLICK, files_per_batch=1)
    pipelines.drain(pipelines.clean_click_stream(feed, tables, threshold=2), 300)

    listed, counts, kept = _expected_clean(batches, 2)
    assert sorted(r[0] for r in tables.blacklist.all(spark).collect()) == sorted(listed) == [1, 2, 3, 4]
    totals = tables.user_counts.totals(spark).collect()
    assert {(r["date"], r["user_id"], r["ad_id"]): r["click_count"] for r in totals} == counts
    kept_frame = spark.createDataFrame(kept, AD_CLICK)
    assert _same(tables.clicks.all(spark), kept_frame)
    assert _same(tables.stat.totals(spark), adclicks.ad_stat(kept_frame))
    assert _same(tables.province_top3(spark), adclicks.province_top_ads(adclicks.ad_stat(kept_frame)))


def test_repeating_the_last_batch_changes_nothing(spark, feed, tmp_path):
    tables = AdTables(str(tmp_path / "out"), keep_clicks=True)
    pipelines.drain(pipelines.clean_click_stream(feed, tables, threshold=2), 300)

    def state():
        frames = (
            tables.blacklist.all(spark),
            tables.user_counts.totals(spark),
            tables.stat.totals(spark),
            tables.clicks.all(spark),
            tables.province_top3(spark),
        )
        return [sorted(map(str, f.collect())) for f in frames]

    before = state()
    # Take back the commit of the last micro-batch, as if the driver had died before writing it.
    commits = os.path.join(tables.checkpoint("clean_clicks"), "commits")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(os.path.join(commits, name)):
            os.remove(os.path.join(commits, name))
    assert last == 2
    pipelines.drain(pipelines.clean_click_stream(feed, tables, threshold=2), 300)
    assert str(last) in os.listdir(commits)
    assert state() == before


def test_late_clicks_count(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrivals = [
        [(T0, "p", "c", 1, 1)],
        [(T0 + 61 * MINUTE, "p", "c", 1, 1)],
        [(T0 + 61 * MINUTE, "p", "c", 1, 1)],
        [(T0 - MINUTE, "p", "c", 1, 1), (T0 + 30 * MINUTE, "p", "c", 1, 1)],
    ]
    for i, batch in enumerate(arrivals):
        _drop(spark.createDataFrame(batch, AD_CLICK), folder, f"b{i}.parquet", tmp_path)
    tables = AdTables(str(tmp_path / "out"))
    feed = read_parquet_stream(spark, folder, AD_CLICK, files_per_batch=1)
    pipelines.drain(pipelines.trend_stream(feed, tables), 300)
    found = sorted((r["hour"], r["minute"], r["click_count"]) for r in tables.trend.totals(spark).collect())
    assert found == [("08", "59", 1), ("09", "00", 1), ("09", "30", 1), ("10", "01", 2)]


def test_all_queries_on_log_lines(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "lines")
    star.ad_log_lines(spark, sf_dir).select("value").coalesce(1).write.text(folder)
    tables = AdTables(str(tmp_path / "out"))
    queries = start_ad_clicks(read_text_stream(spark, folder), tables, threshold=2, every=None, trend_every=None)
    for query in queries:
        pipelines.drain(query, 300)
    from footfall.sources.adlog import parse_ad_log

    clicks = parse_ad_log(star.ad_log_lines(spark, sf_dir)).clicks
    assert _same(tables.stat.totals(spark), adclicks.ad_stat(clicks))
    assert _same(tables.trend.totals(spark), adclicks.click_trend(clicks))
    heavy = adclicks.heavy_clickers(adclicks.user_daily_counts(clicks), 2)
    assert _same(tables.blacklist.all(spark), heavy)


def test_change_log(spark, tmp_path):
    def rows(*values):
        return spark.createDataFrame([(dt.date(2024, 1, d), k, n) for d, k, n in values], "date DATE, k BIGINT, n BIGINT")

    table = ChangeLog(str(tmp_path / "a"), ["date", "k"], "n", "date DATE, k BIGINT, n BIGINT")
    assert table.totals(spark).count() == 0
    table.write_batch(rows((1, 1, 5), (1, 2, 1)), 0)
    table.write_batch(rows((1, 1, 7), (2, 1, 3)), 1)
    table.write_batch(rows((1, 1, 7), (2, 1, 3)), 1)
    assert sorted(r["n"] for r in table.totals(spark).collect()) == [1, 3, 12]
    assert sorted(r["n"] for r in table.totals(spark, upto=0).collect()) == [1, 5]
    first = [dt.date(2024, 1, 1)]
    assert sorted(r["n"] for r in table.totals(spark, first).collect()) == [1, 12]


def test_the_folders_that_a_batch_reads_are_bounded(spark, tmp_path):
    schema = "date DATE, k BIGINT, n BIGINT"
    counts = ChangeLog(str(tmp_path / "counts"), ["date", "k"], "n", schema, fold_every=5)
    users = BatchLog(str(tmp_path / "users"), "k BIGINT", DataFrame.distinct, fold_every=5)
    for batch_id in range(50):
        for again in range(2 if batch_id % 7 == 0 or batch_id % 5 == 0 else 1):  # some batches are repeated
            counts.fold(spark, batch_id)
            users.fold(spark, batch_id)
            rows = spark.createDataFrame([(dt.date(2024, 1, 1 + batch_id % 3), 1, 1)], schema).coalesce(1)
            counts.write_batch(rows, batch_id)
            users.write_batch(spark.createDataFrame([(batch_id % 4,)], "k BIGINT").coalesce(1), batch_id)
        for log in (counts, users):
            # At each of three levels fewer runs than are folded, for each of the days; and the batch itself.
            assert len(log.folders(spark, batch_id)) <= 3 * (5 - 1) * (3 if log is counts else 1) + 1
    assert sum(r["n"] for r in counts.totals(spark).collect()) == 50
    assert counts.totals(spark, upto=48).agg(F.sum("n")).head()[0] == 49
    assert sorted(r["k"] for r in users.all(spark).collect()) == [0, 1, 2, 3]
    assert len(os.listdir(f"{counts.path}/versions")) <= 4 * 30  # with check sums, two versions a batch at most


def test_replay_equals_a_plain_simulation(spark, clicks, tmp_path):
    tables = AdTables(str(tmp_path / "out"), keep_clicks=True, fold_every=2)
    pipelines.replay(clicks, tables, days=6, threshold=2)
    everything = [tuple(r) for r in clicks.select(*[f.name for f in AD_CLICK.fields]).collect()]
    start = min(c[0] for c in everything).date()
    slices = {}
    for click in everything:
        slices.setdefault((click[0].date() - start).days // 6, []).append(click)
    listed, counts, kept = _expected_clean([slices[k] for k in sorted(slices)], 2)
    assert sorted(r[0] for r in tables.blacklist.all(spark).collect()) == sorted(listed)
    assert sorted(map(str, (tuple(r) for r in tables.clicks.all(spark).collect()))) == sorted(map(str, kept))
    totals = tables.user_counts.totals(spark).collect()
    assert {(r["date"], r["user_id"], r["ad_id"]): r["click_count"] for r in totals} == counts


def test_clicks_of_closed_batches_go(spark, feed, tmp_path):
    tables = AdTables(str(tmp_path / "out"))
    pipelines.drain(pipelines.clean_click_stream(feed, tables, threshold=2), 300)
    assert tables.clicks.rows(spark).count() == tables.clicks.of_batch(spark, 2).count() > 0
    assert len(os.listdir(f"{tables.clicks.path}/data")) <= 3


def test_progress_is_kept_in_the_checkpoint(spark, feed, tmp_path):
    tables = AdTables(str(tmp_path / "out"))
    for _ in range(2):
        pipelines.drain(pipelines.trend_stream(feed, tables), 300)
    offsets = os.path.join(tables.checkpoint("ad_click_trend"), "offsets")
    assert {"0", "1", "2"} <= set(os.listdir(offsets))
    with open(os.path.join(offsets, "2")) as file:
        assert json.loads(file.read().splitlines()[-1]) == {"logOffset": 2}


def test_log_lines_fan_out_and_a_repeated_batch_changes_nothing(spark, sf_dir, tmp_path):
    from footfall.sources.adlog import parse_ad_log

    lines = star.ad_log_lines(spark, sf_dir).withColumn("n", F.monotonically_increasing_id() % 3)
    tables = AdTables(str(tmp_path / "out"), fold_every=2)
    for batch_id in (0, 0, 1, 2, 2):
        pipelines.log_line_batch(spark, lines.where(F.col("n") == batch_id).drop("n"), batch_id, tables)
    whole = parse_ad_log(lines.drop("n"))
    assert _same(tables.log_clicks.all(spark), whole.clicks)
    assert _same(tables.log_quarantine.all(spark), whole.quarantine) and whole.quarantine.count() > 0
    assert _same(tables.stat.totals(spark), adclicks.ad_stat(whole.clicks))
    # The batch died after its clicks were written and before anything else was.
    tables.log_clicks.write_batch(whole.clicks, 3)
    pipelines.log_line_batch(spark, spark.createDataFrame([("damaged",)], "value string"), 3, tables)
    assert _same(tables.log_clicks.all(spark), whole.clicks)
    assert tables.log_quarantine.all(spark).where("line = 'damaged'").count() == 1


def test_windows_close_once_and_late_clicks_are_kept(spark, clicks, tmp_path):
    everything = sorted(tuple(r) for r in clicks.select(*[f.name for f in AD_CLICK.fields]).collect())
    batches = [everything[n : n + 150] for n in range(0, len(everything), 150)]
    for n in range(1, len(batches)):  # some clicks come a batch too late
        late, batches[n - 1] = batches[n - 1][::9], [c for i, c in enumerate(batches[n - 1]) if i % 9]
        batches[n] = batches[n] + late
    tables = AdTables(str(tmp_path / "out"), fold_every=3)
    hour, wait, newest = dt.timedelta(hours=1), dt.timedelta(minutes=20), None
    late, counts, emitted, seen = [], {}, {}, []
    for batch_id, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, AD_CLICK)
        for _ in range(2 if batch_id in (2, 3) else 1):
            pipelines.closed_window_batch(spark, frame, batch_id, tables, "60 minutes", "20 minutes")
        mark = newest - wait if newest else None
        newest = max([c[0] for c in batch] + ([newest] if newest else []))
        for click in batch:
            start = click[0].replace(minute=0, second=0, microsecond=0)
            if mark is not None and start + hour <= mark:
                late.append(click)
            else:
                counts[start, click[4]] = counts.get((start, click[4]), 0) + 1
        for (start, ad), n in counts.items():
            if start + hour <= newest - wait and (start, ad) not in emitted:
                emitted[start, ad] = n
        seen.append(tables.closed_windows.of_batch(spark, batch_id).count())
    rows = tables.closed_windows.rows(spark).collect()
    assert {(r.window_start, r.ad_id): r.click_count for r in rows} == {
        (s.replace(tzinfo=None), a): n for (s, a), n in emitted.items()
    }
    assert len(rows) == len(emitted) == sum(seen) and sum(n > 0 for n in seen) > 1 and late
    assert _same(tables.late_clicks.rows(spark), spark.createDataFrame(late, AD_CLICK))
    open_ones = {k: n for k, n in counts.items() if k not in emitted}
    assert sum(emitted.values()) + sum(open_ones.values()) + len(late) == len(everything)
