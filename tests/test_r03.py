"""Rows that a review of the library found to go wrong."""
import math
import threading

import pyarrow as pa
from pyspark.sql import functions as F

from fansignal.functions import scoring as sc
from fansignal.functions import text as tx
from fansignal.operators import dedup as dd
from fansignal.operators import features as feat
from fansignal.operators import model as mdl
from fansignal.operators import sentiment as sent
from fansignal.plans import catalog
from fansignal.sources import fixtures as fx
from fansignal.sources.shared import SharedResults


def test_rounding_keeps_weights_beyond_the_decimal(spark):
    """f05: the weight of a post days after ``as_of`` leaves decimal(38,12)."""
    posts = spark.createDataFrame([(1, 0.0), (2, 3000.0), (3, 40000.0), (4, None)], "post_id long, minutes double")
    at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    later = at + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minutes").cast("int"))
    w = posts.select("post_id", sc.time_decay_weight(later, at).alias("w"), F.lit(2 / 3).alias("x"))
    got = {r.post_id: (r.w, r.x) for r in catalog._round(w).collect()}
    assert got == {1: (1.0, 0.666667), 2: (2.0 ** 100, 0.666667), 3: (math.inf, 0.666667), 4: (1.0, 0.666667)}


def _tables(spark, root, documents):
    """A folder with the tables that the match and post views read: two finished matches of
    TEAM_1 and TEAM_3, and the given (doc_id, text) posts."""
    rows = {
        "customer": ([(1, 1)], "c_custkey long, c_nationkey int"),
        "orders": ([(1, 1, "F", "1-URGENT"), (25, 1, "F", "2-HIGH")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "lineitem": ([(1, 5, 2, 1, 3.0, "R", "F"), (25, 7, 3, 1, 4.0, "A", "F")],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"),
        "documents": ([(i, t, "en", "web", len(t)) for i, t in documents], "doc_id long, text string, lang string, source string, n_chars long"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_team_sentiment_counts_every_post(spark, tmp_path):
    """h03: posts of any time, not those of eight hours only (doc_id is the minute)."""
    where = _tables(spark, tmp_path, [(15, "TEAM_1 great"), (303, "TEAM_1 awful"), (30007, "TEAM_1 great"), (50007, "TEAM_1 great")])
    got = {r.team: (r.post_count, r.positive_ratio, r.negative_ratio) for r in catalog.h03_team_sentiment(spark, where).collect()}
    assert got["TEAM_1"] == (4, 0.75, 0.25)


def _near_by_hand(rows, threshold=0.8, k=3):
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        s = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset(w)
        if s and s not in sets:
            sets[s] = i
    found = [(i, j, len(a & b) / len(a | b)) for a, i in sets.items() for b, j in sets.items() if i < j]
    return sorted((i, j, round(x, 9)) for i, j, x in found if x >= threshold)


def test_near_duplicates_explode_the_shingles_once_a_side(spark):
    """e03, e05, e06: the shingles are shuffled once to be counted, and pairs stay exact."""
    words = [f"w{i % 37}x{i % 11}" for i in range(400)]
    rows = [(i, " ".join(words[i * 7:i * 7 + 40])) for i in range(40)]
    rows += [(100 + i, " ".join([*words[i * 7:i * 7 + 38], "odd", "end"])) for i in range(40)] + [(200, rows[3][1]), (201, ""), (202, None), (203, "two words"), (204, "two words")]
    posts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ts", F.col("doc_id"))
    pairs = dd.near_duplicate_pairs(posts)
    assert sorted((r.earlier_id, r.later_id, round(r.jaccard, 9)) for r in pairs.collect()) == _near_by_hand(rows)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2     # one for either side of the pair


def test_team_tokens_are_stored_before_the_posts_meet_them(spark):
    """f15, h02, h03, team table: the planner sees the bytes of the team tokens, not of the matches."""
    posts = spark.createDataFrame([(1, "TEAM_1 v team_3 team_3"), (2, "nobody"), (3, None)], "post_id long, text string")
    teams = spark.createDataFrame([("TEAM_1",), ("TEAM_3",), ("TEAM_1",), (None,)], "team string")
    pairs = sent.post_team_pairs(posts, teams)
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, "TEAM_1"), (1, "TEAM_3")]
    assert any("team-tokens" in f for f in pairs.inputFiles())


def test_match_views_have_partitions_by_the_bytes_of_the_tables(spark, tmp_path, monkeypatch):
    """i01, i19, a12, m01, m08, a16: the rows of one task do not grow with the tables."""
    where = _tables(spark, tmp_path, [(1, "x")])
    monkeypatch.setattr(fx, "PART_BYTES", 64, raising=False)
    events = fx.fixture_events_v(spark, where)
    assert events.rdd.getNumPartitions() > 50
    assert sorted((r.fixture_id, r.pos, r.type) for r in events.collect()) == [(1, 1, "Goal"), (25, 1, "Card")]


def test_a_task_of_the_match_views_holds_4_mb_of_files(spark, monkeypatch):
    """i19, a12: four sorts of a task's lines lie in memory at once."""
    monkeypatch.setattr(fx, "file_bytes", lambda spark, path: 300 << 20)
    assert fx._parts(spark, "any") >= 150


def test_accents_go_by_slices_of_a_batch():
    """d08: a batch is an Arrow array, of which a few texts at a time are Python strings."""
    texts = ["café", None, "plain", "ﬁn ", ""] * 150
    got = tx._nfkd_strip(pa.array(texts, pa.string())).to_pylist()
    assert got == ["cafe", None, "plain", "fin ", ""] * 150
    assert len(tx._nfkd_strip(pa.array([], pa.string()))) == 0


def test_boosted_classifiers_are_fitted_side_by_side(spark, monkeypatch):
    """l06: all three are under way at once, on rows that are stored once."""
    from pyspark.ml.classification import GBTClassifier
    meet, read = threading.Barrier(3, timeout=60), []

    def fit(self, data):
        read.append(any("training-rows" in f for f in data.inputFiles()))
        meet.wait()
        return data.groupBy("y").count().orderBy("y").collect()
    monkeypatch.setattr(GBTClassifier, "fit", fit)
    frame = spark.createDataFrame([(i % 3 if i else 1, *[float(i)] * len(mdl.FEATURE_NAMES)) for i in range(6)], ["label", *mdl.FEATURE_NAMES])
    got = mdl.fit_boosted(frame)
    assert [[tuple(r) for r in m] for m in got] == [[(0.0, 5), (1.0, 1)], [(0.0, 3), (1.0, 3)], [(0.0, 4), (1.0, 2)]]
    assert read == [True] * 3


def test_a_build_longer_than_the_limit_is_built_once(spark, tmp_path):
    """m02, l09 fitted: the limit counts from the moment at which a result can be read."""
    clock, built = [1000.0], []

    def build():
        built.append(1)
        clock[0] += 400
        return spark.range(3)
    results = SharedResults(spark, str(tmp_path / "out"), clock=lambda: clock[0])
    assert [results.get("teams", build, [], ttl=300).count() for _ in range(2)] == [3, 3] and len(built) == 1
    clock[0] += 300
    assert results.get("teams", build, [], ttl=300).count() == 3 and len(built) == 2


def test_leaderboards_read_the_team_table_once(spark, monkeypatch):
    """m02, l09 fitted: a fit or a ranking between two reads made the table old, and it was built again."""
    teams = spark.createDataFrame([("A", 2.0, 3, 4.0, 5), ("B", 1.0, 1, 1.0, 5)], "team string, form_score double, goal_difference int, total_points double, matches_played int")
    read = []
    monkeypatch.setattr(catalog, "_team_table", lambda *a: read.append(1) or teams.withColumn("avg_sentiment", F.lit(0.5)))
    monkeypatch.setattr(catalog, "_finished", lambda *a: None)
    monkeypatch.setattr(mdl, "training_frame", lambda finished, profile: None)
    monkeypatch.setattr(mdl, "fit_logistic", lambda frame: (mdl.reference_scorer(), {}))
    for query in (catalog.m02_leaderboard_table, catalog.l09_leaderboard_fitted):
        read.clear()
        assert [r.team for r in query(spark, "none").orderBy("rank").collect()] == ["A", "B"]
        assert len(read) == 1


def test_form_ranks_only_matches_that_can_have_a_weight(spark):
    """m02, l09 fitted (team table): days before the newest 3,340 matches of a team are not shuffled."""
    ids = spark.range(9000).withColumn("day", F.when(F.col("id") < 4000, 1).when(F.col("id") < 8000, 2).otherwise(3))
    m = ids.select(F.col("id").alias("match_id"), F.lit("x").alias("stage"), F.make_timestamp_ntz(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)).alias("utc_date"),
                   F.lit("A").alias("home_team"), F.when(F.col("id") < 2, "B").otherwise("A2").alias("away_team"),
                   *[(F.col("id") % (3 + i)).cast("int").alias(c) for i, c in enumerate(("home_score_ft", "away_score_ft", "home_score_ht", "away_score_ht"))],
                   F.when(F.col("id") % 2 == 0, "HOME_TEAM").otherwise("DRAW").alias("winner"),
                   F.lit(None).cast("array<struct<team:string>>").alias("goals"), F.lit(None).cast("array<struct<team:string>>").alias("cards"))
    rows = feat.team_match_rows(m)
    part = feat.with_recency_weight(rows, weighted_only=True)
    assert {r.team: r["count"] for r in part.groupBy("team").count().collect()} == {"A": 5000, "A2": 5000, "B": 2}
    whole = {r.team: (r.w, r.p) for r in feat.with_recency_weight(rows).groupBy("team").agg(F.sum("weight").alias("w"), F.sum(F.col("points") * F.col("weight")).alias("p")).collect()}
    got = {r.team: r for r in feat.team_features(m).collect()}
    assert {t: r.matches_played for t, r in got.items()} == {"A": 9000, "A2": 8998, "B": 2}
    assert all(abs(got[t].form_score - p / w) < 1e-12 for t, (w, p) in whole.items())


def test_events_are_made_for_wanted_fixtures_only(spark, tmp_path):
    """m02, l09 fitted (stored matches): a scheduled match's lines go before they are sorted and grouped."""
    where = _tables(spark, tmp_path, [(1, "x")])
    assert fx.fixture_events_v(spark, where, ["LIVE", "FINISHED"]).count() == 2 and fx.fixture_events_v(spark, where, ["LIVE"]).count() == 0
    more = spark.createDataFrame([(25, 1, "O", "1-URGENT"), (1, 1, None, None)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    more.write.mode("append").parquet(f"{where}/orders.parquet")
    for statuses in (["FINISHED"], ["SCHEDULED"], [""]):     # a key's events are those of all its rows
        want = {r.fixture_id for r in fx.fixtures_raw_v(spark, where).select(F.col("fixture.id").alias("fixture_id"), F.col("fixture.status.short").alias("s")).collect()
                if {"FT": "FINISHED", "NS": "SCHEDULED", None: ""}[r.s] in statuses}
        rows = lambda df: sorted((r.fixture_id, r.pos, r.type) for r in df.collect())
        assert rows(fx.fixture_events_v(spark, where, statuses)) == [r for r in rows(fx.fixture_events_v(spark, where)) if r[0] in want]
