"""A model is judged on matches it has not seen and entered in a registry of versions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fansignal.sources.published import Folder

APPROVED, PENDING = "Approved", "PendingManualApproval"      # fixed values
THRESHOLD = 0.5                                              # fixed value: accuracy above which a model is approved
LEAST = 1e-15                                                # probabilities are not taken below this in the log loss


def held_out(frame: DataFrame, key: str, percent: int = 20, seed: int = 12) -> tuple[DataFrame, DataFrame]:
    """(training, held-out) rows by a hash of the key: the same match is always on the same
    side, whatever else is in the frame; equal keys never part."""
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(100)) < percent
    return frame.filter(~part), frame.filter(part)


def _log_loss(label: Column, probabilities: list[Column]) -> Column:
    pick = reduce(lambda acc, c: acc.when(label == c[0], c[1]), list(enumerate(probabilities)), F.when(F.lit(False), 0.0))
    return -F.avg(F.log(F.least(F.greatest(pick, F.lit(LEAST)), F.lit(1.0))))


def evaluate(train: DataFrame, test: DataFrame, probabilities: list[Column], label: str = "label") -> DataFrame:
    """One row over the held-out rows: n_train, n_test, accuracy, log_loss, and prior_log_loss, the
    loss of always giving the class shares of the training rows (add-one smoothed). Metrics are NULL where nothing
    is held out."""
    classes = range(len(probabilities))
    shares = train.agg(F.count(F.lit(1)).alias("n_train"), *[F.count_if(F.col(label) == c).alias(f"_c{c}") for c in classes])
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-c).alias("c")) for c, p in enumerate(probabilities)]))
    d = test.crossJoin(F.broadcast(shares))        # one row
    prior = [(F.col(f"_c{c}") + 1) / (F.col("n_train") + len(probabilities)) for c in classes]
    scores = d.agg(F.count(F.lit(1)).alias("n_test"), F.avg((-best["c"] == F.col(label)).cast("double")).alias("accuracy"),
                   _log_loss(F.col(label), probabilities).alias("log_loss"), _log_loss(F.col(label), prior).alias("prior_log_loss"))
    return shares.select("n_train").crossJoin(F.broadcast(scores))


def judged(metrics: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return metrics.withColumn("status", F.when(F.col("accuracy") > threshold, APPROVED).otherwise(PENDING))


class Registry:
    """Versions 1, 2, ... of models with their metrics, one published file each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def register(self, model: str, metrics: DataFrame, created_at: str, threshold: float = THRESHOLD) -> int:
        """Enter one row of metrics; returns the version. Two writers never get the same one."""
        row = judged(metrics, threshold).first().asDict()
        while True:
            version = len(self.folder.names()) + 1
            if self.folder.publish(f"{version:08d}.json", row | {"version": version, "model": model, "created_at": created_at}):
                return version

    def versions(self) -> DataFrame:
        """All versions, one row each; a handful of entries, read by the driver."""
        rows = [self.folder.read(n) for n in self.folder.names()]
        schema = ("version int, model string, created_at string, n_train long, n_test long, accuracy double, log_loss double, "
                  "prior_log_loss double, status string")
        return self.spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)

    def approved(self) -> DataFrame:
        """The newest approved version, if any."""
        return self.versions().filter(F.col("status") == APPROVED).orderBy(F.col("version").desc()).limit(1)
