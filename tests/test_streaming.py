"""Streaming: a file source in three drops (with a duplicate and an out-of-order row)
drained with availableNow equals the batch result; a restart adds nothing."""
import json
import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fansignal.sources import matches as msrc
from fansignal.sources.schemas import CARD, GOAL

from fansignal.streaming import live
from fansignal.streaming import pipeline as sp
from fansignal.streaming.sink import EpochTable, latest_rows


def _drop(d, name, rows):
    with open(os.path.join(d, name), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def _rows():
    base = {"source": "reddit", "author": "fan", "like_count": 3, "score": 1}
    texts = ["What a worldie from the lad in the final tonight", "The keeper had a howler and we lost the match",
             "Great skill and tekkers from the winger all game", "The referee robbed us with that penalty decision"]
    rows = []
    for i, t in enumerate(texts * 3):
        rows.append({**base, "source_id": f"id{i}", "text": f"{t} number {i}",
                     "timestamp": f"2026-06-{11 + i % 3:02d}T1{i % 10}:00:00Z"})
    return rows


def test_available_now_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="fs-src-")
    rows = _rows()
    _drop(src, "a.json", rows[:5])
    _drop(src, "b.json", rows[5:] + rows[:1])           # a duplicate id
    _drop(src, "c.json", list(reversed(rows[6:8])))     # out of order
    out, ck = tempfile.mkdtemp(prefix="fs-out-"), tempfile.mkdtemp(prefix="fs-ck-")
    stream = sp.dedup_ids(sp.clean_and_score(sp.read_posts(spark, src)), ["source_id"])
    q = sp.write_posts(stream, out, ck, available_now=True)
    q.awaitTermination(120)
    got = EpochTable(spark, out).read()
    batch = spark.read.schema(sp.POSTS_RAW).json(src)
    want = sp.clean_and_score(batch).dropDuplicates(["source_id"])
    assert got.count() == want.count() == len(rows)
    assert sorted(r.source_id for r in got.select("source_id").collect()) == \
        sorted(r.source_id for r in want.select("source_id").collect())
    # restart from the checkpoint: nothing new
    q2 = sp.write_posts(sp.dedup_ids(sp.clean_and_score(sp.read_posts(spark, src)), ["source_id"]), out, ck,
                        available_now=True)
    q2.awaitTermination(120)
    assert EpochTable(spark, out).read().count() == len(rows)


SNAPSHOT = T.StructType([T.StructField("match_id", T.LongType()), T.StructField("snapshot_ts", T.TimestampType()),
                         T.StructField("goals", T.ArrayType(GOAL)), T.StructField("cards", T.ArrayType(CARD))])
G = {"minute": 10, "team": "A", "scorer": "x", "assist": None, "type": "Normal Goal"}


def test_snapshot_diff_stream_forgets_ended_matches(spark, tmp_path):
    src, ck = tmp_path / "snap", str(tmp_path / "ck")
    src.mkdir()
    rows = []
    for day in range(6):        # two matches a day: three snapshots, the middle one twice
        for m in (day * 10, day * 10 + 1):
            rows.append([{"match_id": m, "snapshot_ts": f"2026-06-{11 + day:02d}T10:0{k}:00", "goals": [G] * g, "cards": []}
                         for k, g in enumerate((0, 1, 1, 2))])
        _drop(str(src), f"{day}.json", rows[-2] + rows[-1])
        os.utime(src / f"{day}.json", (1_000_000 + day, 1_000_000 + day))
    s = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).json(str(src))
    q = (live.snapshot_changes_stream(s).writeStream.format("memory").queryName("snapdiff").option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(180)
    got = sorted((r.match_id, r.n_goals) for r in spark.sql("select * from snapdiff").collect())
    assert got == sorted((m, g) for day in range(6) for m in (day * 10, day * 10 + 1) for g in (1, 2))
    # what the batch operator keeps, too
    batch = msrc.snapshot_changes(spark.read.schema(SNAPSHOT).json(str(src)))
    assert got == sorted((r.match_id, r.n) for r in batch.select("match_id", F.size("goals").alias("n")).collect())
    # the state holds the matches of the last hours only
    state = spark.read.format("statestore").option("stateVarName", "counts").load(ck)
    assert sorted(r.key.match_id for r in state.collect()) == [50, 51]


def test_an_epoch_is_taken_once(spark, tmp_path):
    t = EpochTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    batch = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")
    assert t.commit(batch(1, 2), "query", 0) and t.commit(batch(3), "query", 1)
    assert not t.commit(batch(1, 2), "query", 0) and not t.commit(batch(9), "query", 1)      # replays
    assert t.commit(batch(4), "another query", 0)                                            # its epochs are its own
    seen = lambda: sorted(r.id for r in t.read().collect())
    assert seen() == [1, 2, 3, 4]
    # rows whose manifest never came are not read, and the epoch can be run again
    (batch(7).write.parquet(f"{t.data}/left-by-a-crash"))
    assert seen() == [1, 2, 3, 4]
    assert t.commit(batch(5), "query", 2) and seen() == [1, 2, 3, 4, 5]
    # after compaction replays still change nothing and new epochs go on
    t.compact()
    assert seen() == [1, 2, 3, 4, 5] and t.epochs.names() == []
    assert not t.commit(batch(5), "query", 2) and not t.commit(batch(4), "another query", 0)
    assert t.commit(batch(6), "query", 3) and seen() == [1, 2, 3, 4, 5, 6]
    t.compact()
    t.compact()
    assert seen() == [1, 2, 3, 4, 5, 6] and len(t.snapshots.names()) == 2


def test_latest_row_per_key(spark, tmp_path):
    t = EpochTable(spark, str(tmp_path / "m"))
    rows = lambda *r: spark.createDataFrame(r, "match_id long, last_updated long, score int, goals array<int>")
    t.commit(rows((1, 10, 0, []), (2, 10, 0, []), (3, None, 7, [])), "q", 0)
    t.commit(rows((1, 20, 1, [5]), (2, 5, 9, [])), "q", 1)                  # an older row of match 2 comes late
    t.commit(rows((1, 20, 2, [5, 6]), (4, 1, 0, None)), "q", 2)             # a tie in time: the later epoch
    want = [(1, 20, 2), (2, 10, 0), (3, None, 7), (4, 1, 0)]
    now = lambda: sorted((r.match_id, r.last_updated, r.score) for r in t.latest(["match_id"], ["last_updated"]).collect())
    assert now() == want
    t.compact(["match_id"], ["last_updated"])
    assert now() == want and t.read().count() == 4
    t.commit(rows((3, 1, 8, [])), "q", 3)
    assert now()[2] == (3, 1, 8)
    ties = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, None, "z")], "k long, o long, v string")
    assert [tuple(r) for r in latest_rows(ties, ["k"], ["o"]).collect()] == [(1, 1, "b")]


def test_matches_stream_upserts(spark, tmp_path):
    src = tmp_path / "m"
    src.mkdir()
    schema = "match_id long, last_updated long, home_score_ft int"
    for n, rows in enumerate([[(1, 1, 0), (2, 1, 0)], [(1, 2, 1)], [(2, 0, 5), (3, 1, 0)]]):
        _drop(str(src), f"{n}.json", [dict(zip(("match_id", "last_updated", "home_score_ft"), r, strict=True)) for r in rows])
        os.utime(src / f"{n}.json", (1_000_000 + n, 1_000_000 + n))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):                  # the second start finds nothing new
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
        sp.write_matches(s, out, ck, available_now=True, compact_every=2).awaitTermination(120)
        t = EpochTable(spark, out)
        assert sorted(tuple(r) for r in t.latest(["match_id"], ["last_updated"]).drop("epoch_seq").collect()) == [(1, 2, 1), (2, 1, 0), (3, 1, 0)]
    assert len(t.snapshots.names()) == 1 and len(t.epochs.names()) == 1


def test_rolling_dedup_stream_equals_batch(spark, tmp_path):
    from fansignal.operators import dedup as dd
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "", "alpha beta gamma delta"]
    rows = [{"id": i, "ts": i, "source": "ab"[i % 2], "text": texts[i // 2 % 4]} for i in range(24)]
    d = tmp_path / "posts"
    d.mkdir()
    schema = "id long, ts long, source string, text string"
    for n, part in enumerate((rows[:7], rows[7:15][::-1], rows[15:])):
        _drop(str(d), f"{n}.json", part)
        os.utime(d / f"{n}.json", (1_000_000 + n, 1_000_000 + n))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(d))
    q = (sp.rolling_dedup_stream(s).writeStream.format("memory").queryName("ringdedup")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted(r.id for r in spark.sql("select id from ringdedup").collect())
    want = dd.rolling_dedup(spark.read.schema(schema).json(str(d)), ["source"], ["ts", "id"])
    assert got == sorted(r.id for r in want.collect())
    assert len([i for i in got if rows[i]["text"]]) == 6 and len(got) == 12   # empty posts all stay
