"""Streams: versions that one writer wins, a lost position, late and repeated changes, work that is tried again."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from shutterlake.operators import mutations
from shutterlake.sources import shared
from shutterlake.streaming import changes, work

FEED = "sequence long, at timestamp_ntz, asset_id long, op string, bytes long"


def feed(n, seed=1, assets=12):
    rng = random.Random(seed)
    return [(i, datetime(2024, 1, 1) + timedelta(minutes=i), rng.randrange(assets), rng.choice(["insert", "update", "update", "delete"]), i) for i in range(n)]


def after(rows):
    table = {}
    for _, at, asset, op, size in rows:
        table.pop(asset, None)
        if op != "delete":
            table[asset] = (at, size)
    return {k: v[1] for k, v in table.items()}


def stored(df):
    return {r.asset_id: r.bytes for r in df.collect()}


def write(spark, rows, path, schema=FEED):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_one_of_two_writers_wins(spark, tmp_path):
    table = changes.SnapshotTable(spark, str(tmp_path / "t"))
    rows = [spark.createDataFrame([(w, None, w)] * 50, changes.TABLE) for w in range(4)]
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda w: table.publish(rows[w], 0, {"writer": w}), range(4)))
    assert sum(won) == 1 and table.version == 0
    assert {r.bytes for r in table.read().collect()} == {won.index(True)} == {table.note()["writer"]} and table.read().count() == 50
    assert [p.name for p in Path(tmp_path / "t").iterdir() if not p.name.startswith(".")] == ["v=0"]
    assert shared.move_new(spark, str(tmp_path / "t/v=0"), str(tmp_path / "t/v=1")) and table.version == 1
    table.publish(rows[0], 2)
    table.publish(rows[0], 3)
    table.prune(1)
    assert table.version == 3 and table._versions() == [3]


def test_stale_writer_raises_and_writes_nothing(spark, tmp_path):
    table = changes.SnapshotTable(spark, str(tmp_path / "t"))
    batch = spark.createDataFrame(feed(3), FEED)

    def slow(stored_, fresh):
        table.publish(spark.createDataFrame([(99, None, 1)], changes.TABLE), 0)  # another writer, meanwhile
        return mutations.apply_changes(stored_, mutations.fold(fresh))

    try:
        changes.apply_batch(table, "a", slow)(batch, 0)
    except changes.StaleWriter:
        pass
    else:
        raise AssertionError("it published over another writer")
    assert stored(table.read()) == {99: 1} and table.version == 0


def test_changes_during_a_scan_are_neither_lost_nor_doubled(spark, tmp_path):
    rows, source = feed(90), str(tmp_path / "feed")
    table = changes.SnapshotTable(spark, str(tmp_path / "t"))
    write(spark, rows[:20], source)
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(source)
    changes.apply_stream(stream, table, str(tmp_path / "lost")).awaitTermination(120)
    write(spark, rows[20:50], source)

    def scan():
        """Sees half of what arrives while it runs; the rest arrives as it ends."""
        write(spark, rows[50:60], source)
        state = [(k, None, v) for k, v in after(rows[:55]).items()]
        write(spark, rows[60:70], source)
        return spark.createDataFrame(state, changes.TABLE)

    version = changes.recover(table, spark.read.schema(FEED).parquet(source), scan)
    assert table.note(version)["position"] == 49 and stored(table.read()) == after(rows[:55])
    seen = []
    for more in ([], rows[70:80], rows[80:]):
        if more:
            write(spark, more, source)
        changes.apply_stream(stream, table, str(tmp_path / "new")).awaitTermination(120)
        seen.append(table.note()["batch"])
    # A batch folds to the last change of an asset, but a delete anywhere in it wins: here each file is a batch.
    want = after(rows[:55])
    for part in (rows[50:60], rows[60:70], rows[70:80], rows[80:]):
        gone = {r[2] for r in part if r[3] == "delete"}
        for _, _, asset, _, size in part:
            want[asset] = size
        want = {k: v for k, v in want.items() if k not in gone}
    assert stored(table.read()) == want and seen == sorted(set(seen)) and table.note()["position"] == 49


def test_a_shuffled_and_doubled_feed_gives_the_same_table(spark, tmp_path):
    rows = feed(120, 5)
    rng = random.Random(7)
    mixed = rows + rng.sample(rows, 60)
    rng.shuffle(mixed)
    source = str(tmp_path / "feed")
    for i in range(0, len(mixed), 45):
        write(spark, mixed[i : i + 45], source)
    table = changes.SnapshotTable(spark, str(tmp_path / "t"), changes.LATEST)
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(source)
    changes.apply_any_order(stream, table, str(tmp_path / "cp"), late="1 day").awaitTermination(180)
    assert stored(changes.present(table.read())) == after(rows)
    assert table.read().count() == len({r[2] for r in rows})
    counted = stream.transform(lambda d: changes.deduplicated(d, "1 day")).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    counted.awaitTermination(120)
    assert sorted(r.sequence for r in spark.table("once").collect()) == [r[0] for r in rows]


def flaky(text):
    if text.startswith("bad"):
        raise ValueError(text)
    return [float(len(text))]


def test_failed_work_is_tried_again_and_ends_as_the_batch_does(spark, tmp_path):
    """Items fail for good; each file moves the watermark on, so that some of their timers run out."""
    start = datetime(2024, 1, 1)
    items = [(1, "bad", 0), (2, "fine", 0), (3, "bad too", 10), (4, None, 10)] + [(100 + i, "tick", t) for i, t in enumerate((31, 95, 200, 460, 461, 1000, 1001))]
    source = str(tmp_path / "items")
    times = sorted({t for *_, t in items})
    for t in times:
        write(spark, [(a, text, start + timedelta(seconds=s)) for a, text, s in items if s == t], source, "asset_id long, text string, at timestamp_ntz")
    stream = spark.readStream.schema("asset_id long, text string, at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(source)
    query = work.index_stream(stream, flaky, most=4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    attempts = spark.read.parquet(str(tmp_path / "out"))
    tried = sorted((r.asset_id, r.failures, r.status, r["at"]) for r in attempts.where("asset_id IN (1, 3, 4)").collect())
    # Failures at 0, then 30, 90 and 210 seconds after the first; the fourth is the last.
    for asset, first in ((1, 0), (3, 10), (4, 10)):
        at = [start + timedelta(seconds=first + s) for s in (0, 30, 90, 210)]
        assert [(f, s, x) for a, f, s, x in tried if a == asset] == [(1, "failed", at[0]), (2, "failed", at[1]), (3, "failed", at[2]), (4, "dead", at[3])]
    # The same by batches: mark_failed at the time of each attempt.
    rows = spark.createDataFrame([(1, "pending", None, 0)], "asset_id long, status string, retry_at timestamp_ntz, failures int")
    for f, seconds in enumerate((0, 30, 90)):
        rows = mutations.mark_failed(rows, rows, start + timedelta(seconds=seconds))
        r = rows.first()
        mine = attempts.where(f"asset_id = 1 AND failures = {f + 1}").select("status", "failures", F.col("retry_at").cast("timestamp_ntz").alias("retry_at")).first()
        assert (mine.status, mine.failures, mine.retry_at) == (r.status, r.failures, r.retry_at)
    last = {r.asset_id: (r.status, r.failures) for r in work.last_attempts(attempts).collect()}
    assert last[1] == last[3] == last[4] == ("dead", 4) and last[2] == ("ready", 0) and all(last[100 + i] == ("ready", 0) for i in range(7))


def test_an_encoder_may_take_many_texts_at_once():
    class Many:
        calls = 0

        def encode(self, text):
            return flaky(text)

        def encode_all(self, texts):
            self.calls += 1
            return [flaky(t) for t in texts]

    m = Many()
    assert mutations.encoded(["a", "bb"], m.encode) == [[1.0], [2.0]] and m.calls == 1
    assert mutations.encoded(["a", "bad", None], m.encode) == [[1.0], None, None]
    assert mutations.encoded(["bad", "b"], flaky) == [None, [1.0]]


def test_a_position_is_set_and_cleared(spark, tmp_path):
    kept = changes.Position(spark, str(tmp_path / "position"))
    assert kept.get() is None
    for p in (5, 7):
        kept.set(p)
        assert kept.get() == p == changes.Position(spark, kept.path).get()
    kept.clear()
    assert kept.get() is None and list(Path(tmp_path).iterdir()) == []


def test_writes_in_threads_leave_the_session_as_it_was(spark, tmp_path):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    with ThreadPoolExecutor(3) as pool:
        rows = list(pool.map(lambda k: shared.write(spark.range(50 + k).groupBy(F.col("id") % 3).count(), str(tmp_path / str(k))).count(), range(3)))
    assert rows == [3, 3, 3] and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (before, "false")
