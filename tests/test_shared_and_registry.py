"""Point-in-time view, language vote, shared results, declared tables, export and registry."""
import os
import threading

import pytest
from pyspark.sql import functions as F

from fansignal.functions import language as lg
from fansignal.operators import asof
from fansignal.operators import model as mdl
from fansignal.operators import registry as reg
from fansignal.sources.shared import SharedResults
from fansignal.sources.store import append_checked, ensure_table, export_training_csv, read_training_csv

HOUR = 3_600_000_000


def times(df, *cols):
    return df.withColumns({c: F.to_timestamp_ntz(c) for c in cols})


@pytest.mark.parametrize("width", [HOUR, 24 * HOUR, 3650 * 24 * HOUR])
def test_as_of(spark, width):
    snaps = times(spark.createDataFrame([
        ("A", "2024-01-01 10:00:00", 1), ("A", "2024-01-03 10:00:00", 2), ("A", "2024-01-03 10:00:00", 3), ("B", "2024-01-02 00:00:00", None),
        (None, "2024-01-01 00:00:00", 9), ("A", None, 9)], "team string, since string, v int"), "since")
    asked = times(spark.createDataFrame([
        (1, "A", "2024-01-01 09:59:59"), (2, "A", "2024-01-01 10:00:00"), (3, "A", "2024-01-02 23:00:00"), (4, "A", "2024-01-03 10:00:00"),
        (5, "A", "2025-01-01 00:00:00"), (6, "B", "2024-01-02 00:00:01"), (7, "C", "2024-01-02 00:00:00"), (8, None, "2024-02-01 00:00:00"),
        (9, "A", None), (5, "A", "2025-01-01 00:00:00")], "n int, team string, at string"), "at")
    got = sorted((r.n, r.v, str(r.since)) for r in asof.as_of(asked, snaps, "team", "at", "since", width=width).collect())
    none = (None, "None")
    want = [(1, *none), (2, 1, "2024-01-01 10:00:00"), (3, 1, "2024-01-01 10:00:00"), (4, 3, "2024-01-03 10:00:00"), (5, 3, "2024-01-03 10:00:00"),
            (5, 3, "2024-01-03 10:00:00"), (6, None, "2024-01-02 00:00:00"), (7, *none), (8, *none), (9, *none)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    young = {r.n: r.v for r in asof.as_of(asked, snaps, "team", "at", "since", width=width, max_age=20 * HOUR).collect()}
    assert young == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: None, 7: None, 8: None, 9: None}
    with pytest.raises(ValueError):
        asof.as_of(asked.withColumn("v", F.lit(1)), snaps, "team", "at", "since")


def test_as_of_makes_no_pairs(spark):
    """A hot team: no join between requests and snapshots, windows by team and slice only."""
    snaps = spark.range(1000).select(F.lit("A").alias("team"), F.timestamp_seconds("id").alias("since"), F.col("id").alias("v"))
    asked = spark.range(1000).select(F.lit("A").alias("team"), F.timestamp_seconds(F.col("id") + 0.5).alias("at"), F.col("id").alias("n"))
    d = asof.as_of(asked, snaps, "team", "at", "since", width=10_000_000)
    assert d.filter("n = v").count() == 1000
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window") == 2


def test_language_vote(spark):
    rows = [("The cat and the dog were in the house.", "en"), ("Le chat est dans la maison avec les enfants.", "fr"),
            ("Der Hund ist nicht in dem Haus und die Katze auch nicht.", "de"), ("El perro no está en la casa por los niños.", "es"),
            ("EL PERRO NO ESTA EN LA CASA POR LOS NINOS", "es"), ("xyzzy 123", "unknown"), ("", "unknown"), (None, "unknown"), ("la", "unknown")]
    got = spark.createDataFrame(rows, "text string, want string").withColumn("got", lg.detect_by_vote(F.col("text"))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_language_vote_accuracy(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    right = d.select(F.avg((lg.detect_by_vote(F.col("text")) == F.col("lang")).cast("double"))).first()[0]
    assert right >= 0.95


def test_shared_results(spark, tmp_path):
    src, clock, built = str(tmp_path / "in"), [1000.0], []
    spark.range(3).write.parquet(src)

    def build():
        built.append(1)
        return spark.read.parquet(src).withColumn("built", F.lit(len(built)))
    results = SharedResults(spark, str(tmp_path / "out"), clock=lambda: clock[0])
    get = lambda **k: results.get("features", build, [src], ttl=300, **k).first().built
    assert [get(), get()] == [1, 1]
    clock[0] += 299
    assert get() == 1
    clock[0] += 1                       # the limit has passed
    assert get() == 2
    spark.range(1).write.mode("append").parquet(src)
    assert get() == 3                   # other inputs
    assert get(definition="2") == 4 and get(definition="2") == 4
    clock[0] -= 10_000                  # a clock that went back makes nothing fresh
    assert get(definition="2") == 5
    versions = os.listdir(tmp_path / "out" / "features" / "versions")
    assert len([v for v in versions if v[0] != "."]) == 2 and len(os.listdir(tmp_path / "out" / "features" / "data")) == 2
    # another session's object sees the same table; a name of its own is apart
    again = SharedResults(spark, str(tmp_path / "out"), clock=lambda: clock[0])
    assert again.get("features", build, [src], definition="2").first().built == 5 and again.rebuilt == 0


def test_shared_results_are_whole_while_two_rebuild(spark, tmp_path):
    results = SharedResults(spark, str(tmp_path / "out"), clock=lambda: 1.0)
    counts = []
    work = lambda: counts.append(results.get("r", lambda: spark.range(1000).repartition(4), []).count())
    threads = [threading.Thread(target=work) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert counts == [1000] * 4
    # a writer that died left data without a manifest
    spark.range(5).write.parquet(str(tmp_path / "out" / "r" / "data" / "half"))
    assert results.get("r", lambda: spark.range(1), []).count() == 1000


def test_declared_tables(spark, tmp_path):
    schema = spark.createDataFrame([], "match_id long, goals array<struct<minute:int>>, team string").schema
    path = str(tmp_path / "t")
    spark.sql("DROP TABLE IF EXISTS declared_matches")
    assert ensure_table(spark, "declared_matches", schema, path)
    assert not ensure_table(spark, "declared_matches", schema, path)
    other = spark.createDataFrame([], "match_id int, team string").schema
    with pytest.raises(ValueError, match="another schema"):
        ensure_table(spark, "declared_matches", other, path)
    rows = spark.createDataFrame([(1, [(5,)], "A")], schema)
    append_checked(rows.select("team", "match_id", "goals"), "declared_matches")     # any order of columns
    append_checked(rows, "declared_matches")
    assert spark.table("declared_matches").count() == 2 and spark.table("declared_matches").first().team == "A"
    with pytest.raises(ValueError):
        append_checked(rows.withColumn("match_id", F.col("match_id").cast("int")), "declared_matches")
    spark.sql("DROP TABLE declared_matches")


def test_training_export(spark, tmp_path):
    frame = spark.createDataFrame([(1, 0.1, 2, -3.5), (2, None, 0, 1e-9), (3, 0.30000000000000004, None, 1.0)], "match_id int, x double, label int, y double")
    export_training_csv(frame, str(tmp_path / "csv"), ["x", "y"])
    lines = sorted(line for f in os.listdir(tmp_path / "csv") if f.endswith(".csv") for line in open(tmp_path / "csv" / f).read().splitlines())
    assert lines == ["0,,1.0E-9", "2,0.1,-3.5"]                       # label first, no header, no unlabelled row
    back = read_training_csv(spark, str(tmp_path / "csv"), ["x", "y"])
    assert sorted(map(tuple, back.collect())) == [(0, None, 1e-9), (2, 0.1, -3.5)]


def planted(spark, n, noise):
    """Matches whose outcome follows form_delta, with a share of random ones."""
    d = spark.range(n).withColumn("u", F.rand(5) * 6 - 3).withColumn("r", F.rand(6))
    label = F.when(F.col("r") < noise, F.floor(F.rand(7) * 3)).when(F.col("u") > 1, 2).when(F.col("u") < -1, 0).otherwise(1).cast("int")
    return d.select(F.col("id").alias("match_id"), label.alias("label"),
                    *[(F.col("u") if c == "form_delta" else F.lit(0.0)).alias(c) for c in mdl.FEATURE_NAMES]).persist()


def test_held_out_rows_are_the_same_in_any_frame(spark):
    d = planted(spark, 2000, 0.1)
    train, test = reg.held_out(d, "match_id")
    ids = {r.match_id for r in test.select("match_id").collect()}
    assert train.count() + len(ids) == 2000 and 300 < len(ids) < 500
    half = reg.held_out(d.filter("match_id % 2 = 0"), "match_id")[1]
    assert {r.match_id for r in half.select("match_id").collect()} == {i for i in ids if i % 2 == 0}


def test_model_is_judged_on_unseen_matches(spark, tmp_path):
    d = planted(spark, 3000, 0.1)
    train, test = reg.held_out(d, "match_id")
    model, _ = mdl.fit_logistic(train)
    good = reg.evaluate(train, test, model.proba_columns())
    r = reg.judged(good).first()
    assert r.n_train + r.n_test == 3000 and r.accuracy > 0.85 and r.log_loss < 0.5 * r.prior_log_loss and r.status == reg.APPROVED
    # by hand: a model that always says 0.2 / 0.3 / 0.5
    flat = reg.evaluate(train, test, [F.lit(0.2), F.lit(0.3), F.lit(0.5)]).first()
    labels = [x.label for x in test.collect()]
    import math
    assert flat.accuracy == pytest.approx(labels.count(2) / len(labels))
    assert flat.log_loss == pytest.approx(-sum(math.log((0.2, 0.3, 0.5)[k]) for k in labels) / len(labels))
    registry = reg.Registry(spark, str(tmp_path / "models"))
    assert registry.register("coin", reg.evaluate(train, test, [F.lit(0.2), F.lit(0.3), F.lit(0.5)]), "2024-01-31") == 1
    assert registry.register("logistic", good, "2024-01-31") == 2
    assert [(v.version, v.status) for v in registry.versions().orderBy("version").collect()] == [(1, reg.PENDING), (2, reg.APPROVED)]
    assert registry.approved().first().model == "logistic"


def test_nothing_held_out(spark):
    d = planted(spark, 20, 0.0)
    r = reg.judged(reg.evaluate(d, d.filter("false"), [F.lit(0.2), F.lit(0.3), F.lit(0.5)])).first()
    assert (r.n_train, r.n_test, r.accuracy, r.log_loss, r.status) == (20, 0, None, None, reg.PENDING)
