"""Training, evaluation, tuning and scoring on MLlib; data never leaves the executors."""
from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fixed_values as fv, text
from ..plans.workspace import shared_root, write_through
from ..sources import schemas
from ..sources.tables import append_log, ensure_table, merge_upsert
from . import boosting, score_tables

# Published hyper-parameters and search ranges
REGRESSOR = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 5}
CLASSIFIER = {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 20,
              "featureSubsetStrategy": "0.8"}
#: Rounds without a smaller validation error after which boosting ends.
PATIENCE = 30
#: How many times as long each further training is as the one before: all rounds of one that was too short are done once more.
LONGER = 4
#: Rows from which on a further task is worth its start in every job of boosting.
TASK_ROWS = 10_000
SEED, TRIALS = 42, 20
TRAIN_TEST = {"train": 0.80, "test": 0.20}
TRAIN_VAL_TEST = {"train": 0.70, "val": 0.15, "test": 0.15}


def use_checkpoints(spark: SparkSession) -> None:
    """Let boosting cut its lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_root(spark)}/rdd")


def assembler(columns: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="error")


def assemble_scale(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, PipelineModel]:
    """Feature vector brought to mean 0 and deviation 1."""
    steps = [assembler(columns, "features_raw"),
             StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True)]
    fitted = Pipeline(stages=steps).fit(df)
    return fitted.transform(df), fitted


def split(df: DataFrame, ratios: dict[str, float], key: str = "user_id", strata: str | None = None,
          seed: int = SEED) -> DataFrame:
    """Add ``split`` from a hash of the key: the same on every run and in any layout.

    Without ``strata`` shares hold up to sampling error, with neither shuffle nor
    count.  With ``strata`` each part gets its exact share of every stratum.
    """
    names, bounds, bound = list(ratios), [], 0.0
    for name in names[:-1]:
        bound += ratios[name]
        bounds.append(round(bound, 10))
    if strata:
        return _exact_split(df, names, bounds, key, strata, seed)
    fraction = text.hash_fraction(F.col(key), seed)
    return df.withColumn("split", _part(names, [fraction < b for b in bounds]))


def _part(names: list[str], inside: list) -> Column:
    """The first name whose condition holds, else the last."""
    chosen = F.lit(names[-1])
    for name, condition in reversed(list(zip(names, inside))):
        chosen = F.when(condition, name).otherwise(chosen)
    return chosen


def _exact_split(df: DataFrame, names: list[str], bounds: list[float], key: str, strata: str, seed: int,
                 buckets: int = 4096) -> DataFrame:
    """Per stratum the rows in the order of their hashes, cut at exact positions.

    A histogram of the hashes tells in which bucket each cut lies; only rows of
    such buckets are ranked.  What the rows are compared to is one hash and key
    per stratum and cut.
    """
    fraction = text.hash_fraction(F.concat_ws(":", F.col(strata).cast("string"), F.col(key).cast("string")), seed)
    keys = df.select(F.col(strata).alias("_s"), F.col(key).alias("_k"), fraction.alias("_h"))
    keys = keys.withColumn("_b", F.floor(F.col("_h") * buckets))
    total, running = Window.partitionBy("_s"), Window.partitionBy("_s").orderBy("_b")
    counts = keys.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumns({"_total": F.sum("_n").over(total), "_upto": F.sum("_n").over(running)})
    cuts = F.array(*[F.struct(F.lit(i).alias("i"), F.round(b * F.col("_total")).cast("long").alias("position"))
                     for i, b in enumerate(bounds)])
    cuts = counts.select("_s", "_b", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", F.inline(cuts))
    cuts = cuts.filter((F.col("position") > F.col("_before")) & (F.col("position") <= F.col("_upto")))
    ranked = keys.join(cuts, [keys["_s"].eqNullSafe(cuts["_s"]), keys["_b"] == cuts["_b"]]).select(
        keys["_s"], "i", F.struct("_h", "_k").alias("last"), (F.col("position") - F.col("_before")).alias("rank"),
        F.row_number().over(Window.partitionBy(keys["_s"], "i").orderBy("_h", "_k")).alias("place"))
    last = ranked.filter(F.col("rank") == F.col("place"))
    limits = last.groupBy("_s").agg(*[F.max(F.when(F.col("i") == i, F.col("last"))).alias(f"_last{i}") for i in range(len(bounds))])
    own = F.struct(fraction.alias("_h"), F.col(key).alias("_k"))
    joined = df.join(limits, df[strata].eqNullSafe(limits["_s"]), "left")
    inside = [F.coalesce(own <= F.col(f"_last{i}"), F.lit(False)) for i in range(len(bounds))]
    return joined.select(*[df[c] for c in df.columns], _part(names, inside).alias("split"))


# --- training ------------------------------------------------------------------------

def train_score_regressor(df: DataFrame, columns: Sequence[str], label: str, **params):
    """Boosted trees for the score; returns assembler + model as one pipeline model.

    The rows are spread, see ``spread_rows``.
    """
    use_checkpoints(df.sparkSession)
    df = df.select(*columns, label)
    df = spread_rows(df, df.count())
    gbt = GBTRegressor(labelCol=label, seed=SEED, **{**REGRESSOR, **params})
    return Pipeline(stages=[assembler(columns), gbt]).fit(df)


def class_weights(df: DataFrame, label: str = fv.CONTRACT_LABEL) -> DataFrame:
    """``weight`` = negatives / positives for a positive row, else 1 (one scalar subquery)."""
    positives = F.count_if(F.col(label) == 1)
    ratio = df.agg(F.coalesce(F.try_divide(F.count_if(F.col(label) == 0), positives), F.lit(1.0))).scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)))


def train_default_classifier(df: DataFrame, columns: Sequence[str], label: str = fv.CONTRACT_LABEL,
                             validation: str | None = "is_validation", patience: int = PATIENCE, together: int = 1, **params):
    """Boosted trees for default with class weights, cut to the round of the smallest validation error.

    The positive weight is taken from the training rows.  ``validation`` names a
    boolean column; None trains the given number of rounds on all rows.

    A round is the best if ``patience`` more rounds bring no smaller error, see
    ``boost``.  ``together`` is the number of trainings that run side by side.
    """
    if validation:
        return boost(boosting_rows(df, columns, label, validation, together), columns, label, patience, **params)
    use_checkpoints(df.sparkSession)
    return Pipeline(stages=[assembler(columns), _booster(label, **params)]).fit(_weighted(df, df, label))


@dataclass(frozen=True)
class BoostingRows:
    """What trainings read: vectors, labels, weights and ``held`` of all rows, and of the ``n`` training rows and the validation rows alone."""
    rows: DataFrame
    kept: DataFrame
    judged: DataFrame
    n: int


def boosting_rows(df: DataFrame, columns: Sequence[str], label: str = fv.CONTRACT_LABEL, validation: str = "is_validation",
                  together: int = 1) -> BoostingRows:
    """Rows with vectors and weights, made once for any number of trainings on the same columns, of which ``together`` run side by side.

    Many rows are dealt to the tasks that train.  They are checkpointed as they
    lie, without the plan of all columns.
    """
    use_checkpoints(df.sparkSession)
    weighted = _weighted(df, df.filter(~F.col(validation)), label)
    weighted = write_through(weighted.select(*columns, label, "weight", validation), "boosting")
    weighted = weighted.withColumn("held", F.col(validation)).filter(F.col("held").isNotNull())
    n = weighted.filter("NOT held").count()
    if n > boosting.ONE_TASK:
        weighted = weighted.repartition(boosting.wanted_tasks(df.sparkSession, n, together))
    rows = assembler(columns).transform(weighted).select("features", label, "weight", "held").checkpoint()
    kept, judged = (part.select("features", label, "weight") for part in (rows.filter("NOT held"), rows.filter("held")))
    return BoostingRows(rows, kept, judged, n)


def boost(rows: BoostingRows, columns: Sequence[str], label: str = fv.CONTRACT_LABEL, patience: int = PATIENCE, **params) -> PipelineModel:
    """A training of ``train_default_classifier`` on rows that were made before.

    It ends after the best round and ``patience`` more.  MLlib's sums of the errors
    decide which round is the best; where they differ from the tasks' own in the last
    digit and the end is too near, training is done again up to where it isn't.
    """
    gbt, least = _booster(label, **params), 0
    if not boosting.by_tasks(rows.rows.sparkSession, rows.n):
        return _boost_by_jobs(rows, columns, gbt, patience)
    while True:
        trees = boosting.train(rows.rows, rows.n, gbt, patience, least)
        best = best_round(trees.evaluateEachIteration(rows.judged), patience)
        if best + patience <= trees.getNumTrees or trees.getNumTrees == gbt.getMaxIter():
            return first_trees(PipelineModel([assembler(columns), trees]), best)
        least = best + patience


def _boost_by_jobs(rows: BoostingRows, columns: Sequence[str], gbt: GBTClassifier, patience: int) -> PipelineModel:
    """The same by MLlib's own jobs, where tasks can't exchange sums.

    As long as the end is too near, training is done again with ``LONGER`` times the
    rounds; equal seeds give equal first trees.
    """
    rounds, longest = 0, gbt.getMaxIter()
    while True:
        rounds = min(longest, LONGER * rounds or first_rounds(rows.n, patience))
        trees = gbt.copy({gbt.maxIter: rounds}).fit(rows.kept)
        best = best_round(trees.evaluateEachIteration(rows.judged), patience)
        if best + patience <= rounds or rounds == longest:
            return first_trees(PipelineModel([assembler(columns), trees]), best)


def _booster(label: str, **params) -> GBTClassifier:
    return GBTClassifier(labelCol=label, weightCol="weight", seed=SEED, **{**CLASSIFIER, **params})


def _weighted(df: DataFrame, training: DataFrame, label: str) -> DataFrame:
    positives = F.count_if(F.col(label) == 1)
    ratio = training.agg(F.coalesce(F.try_divide(F.count_if(F.col(label) == 0), positives), F.lit(1.0))).scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)))


def first_rounds(n: int, patience: int) -> int:
    """A first guess at the rounds that ``n`` rows need; it settles how long training takes, not what comes out.

    The more rows, the later the best round: on the given tables it was the 33rd
    for 8,342 rows and the 88th for 83,339.
    """
    return patience + math.ceil(1.2 * n ** 0.4) + 10


def spread_rows(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows in as many parts as there are cores, if their scan has fewer: few columns of many rows fit into one small file.

    Boosting reads its rows as often a round as trees are deep, so a scan of one or
    two parts would leave the other cores idle throughout.  Parts get ``TASK_ROWS`` rows at least;
    a table of fewer stays as it is.
    """
    parts = min(rows.sparkSession.sparkContext.defaultParallelism, n // TASK_ROWS)
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def staged_errors(model: PipelineModel, rows: DataFrame) -> list[float]:
    """The weighted logistic loss on ``rows`` after each round of boosting."""
    return model.stages[-1].evaluateEachIteration(model.stages[0].transform(rows))


def best_round(errors: Sequence[float], patience: int = PATIENCE) -> int:
    """See ``boosting.best_round``."""
    return boosting.best_round(errors, patience)


def first_trees(model: PipelineModel, n: int) -> PipelineModel:
    """The model as it was after ``n`` rounds."""
    whole = model.stages[-1]
    java = whole._java_obj
    gateway = SparkSession.active().sparkContext._gateway
    made = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i, (tree, weight) in enumerate(zip(java.trees(), whole.treeWeights)):
        if i < n:
            trees[i], weights[i] = tree, weight
    cut = made(java.uid(), trees, weights, whole.numFeatures, whole.numClasses)
    return PipelineModel([*model.stages[:-1], type(whole)._from_java(cut)])


def tree_count(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def default_probability(predictions: DataFrame, column: str = "default_probability") -> DataFrame:
    return predictions.withColumn(column, vector_to_array("probability")[1])


# --- metrics ---------------------------------------------------------------------------

def regression_metrics(df: DataFrame, label: str, prediction: str = "prediction", by: str = "split") -> DataFrame:
    """RMSE, MAE and R2 per split, from sums only."""
    error = F.col(label) - F.col(prediction)
    stats = df.groupBy(by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        F.sum(error * error).alias("_sse"), F.var_pop(label).alias("_var"))
    r2 = 1.0 - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n"))
    return stats.withColumn("r2", r2).drop("_sse", "_var")


def overfit_ratio(metrics: DataFrame, by: str = "split") -> DataFrame:
    """Test RMSE over train RMSE."""
    def of(name: str):
        return F.max(F.when(F.col(by) == name, F.col("rmse")))

    return metrics.agg(F.try_divide(of("test"), of("train")).alias("overfit_ratio"))


def f1_at(df: DataFrame, label: str, probability: str, cut: float = 0.5) -> DataFrame:
    hit = F.col(probability) >= cut
    truth = F.col(label) == 1
    counts = df.agg(F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"),
                    F.count_if(~hit & truth).alias("fn"))
    f1 = F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.select(F.coalesce(f1, F.lit(0.0)).alias("f1"))


def classification_metrics(df: DataFrame, label: str = fv.CONTRACT_LABEL, probability: str = "default_probability",
                           bins: int = 0) -> dict[str, float]:
    """AUC-ROC and AUC-PR (exact with ``bins=0``) and F1 at 0.5."""
    scored = df.select(F.col(label).cast("double").alias("label"), F.col(probability).alias("p"))

    def area(metric: str) -> float:
        evaluator = BinaryClassificationEvaluator(
            rawPredictionCol="p", labelCol="label", metricName=metric, numBins=bins)
        return float(evaluator.evaluate(scored))

    return {"auc_roc": area("areaUnderROC"), "auc_pr": area("areaUnderPR"),
            "f1": float(f1_at(scored, "label", "p").first()["f1"])}


def metrics_frame(spark: SparkSession, named: dict[str, dict[str, float]]) -> DataFrame:
    rows = [(name, metric, float(value)) for name, values in named.items() for metric, value in values.items()]
    return spark.createDataFrame(rows, "name string, metric string, value double")


def feature_importance(spark: SparkSession, model, columns: Sequence[str]) -> DataFrame:
    """Gain importance per feature, largest first (model-sized, not data-sized)."""
    trees = model.stages[-1] if isinstance(model, PipelineModel) else model
    values = trees.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(columns, values)), "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def progressive_lift(df: DataFrame, feature_sets: dict[str, Sequence[str]], label: str = fv.CONTRACT_LABEL,
                     **params) -> DataFrame:
    """One classifier per feature set: metrics on validation and test, and lift over the first set.

    ``df`` carries ``split`` with train, val and test.
    """
    df = write_through(df, "lift_rows")
    training = df.filter(F.col("split") != "test").withColumn("is_validation", F.col("split") == "val")

    def judged(columns: Sequence[str]) -> list[dict[str, float]]:
        model = train_default_classifier(training, columns, label, **{"together": len(feature_sets), **params})
        scored = write_through(default_probability(model.transform(df), "_p").select("split", label, "_p"), "lift_scores")
        return [classification_metrics(scored.filter(F.col("split") == part), label, "_p") for part in ("val", "test")]

    with ThreadPoolExecutor(max(len(feature_sets), 1)) as pool:  # Spark runs the jobs of all sets side by side
        found = list(pool.map(inheritable_thread_target(df.sparkSession)(judged), feature_sets.values()))
    rows = [(name, len(columns), val["auc_roc"], val["auc_pr"], val["f1"], test["auc_roc"], test["auc_pr"], test["f1"],
             val["auc_roc"] - found[0][0]["auc_roc"]) for (name, columns), (val, test) in zip(feature_sets.items(), found)]
    return df.sparkSession.createDataFrame(
        rows, "version string, n_features int, val_auc double, val_auc_pr double, val_f1 double, "
              "test_auc double, test_auc_pr double, test_f1 double, lift double")


# --- tuning ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Trial:
    step_size: float
    max_bins: int
    max_depth: int
    min_instances: int
    feature_fraction: float
    subsampling_rate: float
    min_info_gain: float
    max_iter: int


def random_trials(n: int = TRIALS, seed: int = SEED, max_iter: int = CLASSIFIER["maxIter"]) -> list[Trial]:
    """Seeded draws over seven parameters.

    Depth, leaf size, learning rate and both fractions keep their published
    ranges.  MLlib trees have no leaf count and no L1/L2 penalty; bins and the
    least gain of a split take their place.
    """
    draw = random.Random(seed)
    return [from_unit([draw.random() for _ in RANGES], max_iter) for _ in range(n)]


# The searched range of every parameter, and whether it is searched by its logarithm
RANGES = {"step_size": (0.01, 0.15, True), "max_bins": (20, 120, False), "max_depth": (4, 9, False), "min_instances": (10, 50, False),
          "feature_fraction": (0.60, 0.95, False), "subsampling_rate": (0.60, 0.95, False), "min_info_gain": (1e-6, 1e-3, True)}
WHOLE = ("max_bins", "max_depth", "min_instances")
#: The share of finished trials that count as good, and the candidates among which the likeliest to be good is taken.
GOOD, CANDIDATES = 0.25, 24


def to_places(settings, ranges: dict[str, tuple[float, float, bool]]) -> list[float]:
    """Where a setting's values stand in their ranges, each from 0 to 1."""
    place = lambda v, low, high: (v - low) / (high - low)
    return [place(*map(math.log, (getattr(settings, k), low, high))) if by_log else place(getattr(settings, k), low, high)
            for k, (low, high, by_log) in ranges.items()]


def in_ranges(places: Sequence[float], ranges: dict[str, tuple[float, float, bool]], whole: Sequence[str]) -> dict[str, float]:
    values = {}
    for at, (k, (low, high, by_log)) in zip(places, ranges.items()):
        value = math.exp(math.log(low) + at * (math.log(high) - math.log(low))) if by_log else low + at * (high - low)
        values[k] = round(value) if k in whole else value
    return values


def to_unit(trial: Trial) -> list[float]:
    return to_places(trial, RANGES)


def from_unit(places: Sequence[float], max_iter: int) -> Trial:
    return Trial(**in_ranges(places, RANGES, WHOLE), max_iter=max_iter)


class Parzen:
    """A density over 0..1: a normal kernel at every point, as wide as the larger gap to its neighbours, and a uniform part."""

    def __init__(self, points: Sequence[float]):
        self.points = sorted(points)
        edges = [0.0, *self.points, 1.0]
        gaps = [max(b - a, c - b) for a, b, c in zip(edges, edges[1:], edges[2:])]
        self.widths = [min(1.0, max(g, 1.0 / (2 + len(self.points)))) for g in gaps]

    def density(self, x: float) -> float:
        def kernel(m: float, w: float) -> float:
            inside = 0.5 * (math.erf((1 - m) / (w * 2 ** 0.5)) - math.erf(-m / (w * 2 ** 0.5)))
            return math.exp(-((x - m) / w) ** 2 / 2) / (w * (2 * math.pi) ** 0.5 * inside)

        return (1.0 + sum(map(kernel, self.points, self.widths))) / (1 + len(self.points))

    def draw(self, source: random.Random) -> float:
        i = source.randrange(1 + len(self.points))
        if i == len(self.points):
            return source.random()
        while not 0 <= (x := source.gauss(self.points[i], self.widths[i])) <= 1:
            pass
        return x


def propose(finished: Sequence[tuple[Trial, float]], seed: int, max_iter: int = CLASSIFIER["maxIter"]) -> tuple[Trial, float]:
    """The next trial by tree-structured Parzen estimators, and the logarithm of its ratio good : other.

    The best share of finished trials and the rest each get a density per
    parameter.  Candidates are drawn from the good ones' densities; the one whose
    ratio of densities is the largest is proposed.
    """
    ranked = [to_unit(t) for t, _ in sorted(finished, key=lambda x: -x[1])]
    best, ratio = propose_places(ranked, len(RANGES), seed)
    return from_unit(best, max_iter), ratio


def propose_places(ranked: Sequence[Sequence[float]], size: int, seed: int) -> tuple[list[float], float]:
    """A proposal from the places of finished trials, best first."""
    source = random.Random(seed)
    n_good = max(1, math.ceil(GOOD * len(ranked)))
    good, other = ([Parzen(column) for column in zip(*part)] or [Parzen([]) for _ in range(size)] for part in (ranked[:n_good], ranked[n_good:]))
    drawn = [[d.draw(source) for d in good] for _ in range(CANDIDATES)]
    likelihood = lambda u: sum(math.log(g.density(x) / o.density(x)) for g, o, x in zip(good, other, u))
    best = max(drawn, key=likelihood)
    return best, likelihood(best)


TRIALS_SCHEMA = ("trial int, auc double, test_auc double, step_size double, max_bins int, max_depth int, min_instances int, "
                 "feature_fraction double, subsampling_rate double, min_info_gain double, max_iter int, trees int, log_ratio double")


def tune(df: DataFrame, columns: Sequence[str], trials: list[Trial], label: str = fv.CONTRACT_LABEL, proposed: int = 0,
         parallelism: int = 4, seed: int = SEED, **params) -> tuple[DataFrame, Trial, float]:
    """Train every trial, judge it on validation rows, and the best one on rows that none has seen.

    ``df`` carries ``split`` with train, val and test.  Positive weights come from
    train rows, boosting is cut by the validation rows.  After the given trials,
    ``proposed`` more follow, ``parallelism`` at a time, each chosen by what the
    finished ones have shown.  Returns the trials by validation AUC (with the test
    AUC of the best, the trees of each, and the log ratio of proposed ones), the
    best and its test AUC.
    """
    training = write_through(df.filter(F.col("split") != "test").withColumn("is_validation", F.col("split") == "val"), "tuning")
    rows = boosting_rows(training, columns, label, together=parallelism)

    def judged(trial: Trial):
        model = boost(rows, columns, label, stepSize=trial.step_size, maxBins=trial.max_bins,
                      maxDepth=trial.max_depth, minInstancesPerNode=trial.min_instances,
                      featureSubsetStrategy=f"{trial.feature_fraction:.4f}",
                      subsamplingRate=trial.subsampling_rate, minInfoGain=trial.min_info_gain,
                      maxIter=trial.max_iter, **params)
        return model, _auc(model.stages[-1], rows.judged, label)

    trials, ratios = list(trials), [None] * len(trials)
    with ThreadPoolExecutor(parallelism) as pool:  # Spark runs the jobs of several trials side by side
        run = lambda some: list(pool.map(inheritable_thread_target(df.sparkSession)(judged), some))
        found = run(trials)
        for start in range(0, proposed, parallelism):
            known = [(t, auc) for t, (_, auc) in zip(trials, found)]
            fresh = [propose(known, seed * 1000 + start + i, trials[0].max_iter if trials else CLASSIFIER["maxIter"])
                     for i in range(min(parallelism, proposed - start))]
            trials += [t for t, _ in fresh]
            ratios += [r for _, r in fresh]
            found += run([t for t, _ in fresh])
    best = max(range(len(trials)), key=lambda i: found[i][1])
    test_auc = _auc(found[best][0], df.filter(F.col("split") == "test"), label)
    table = df.sparkSession.createDataFrame(
        [(i + 1, auc, test_auc if i == best else None, *asdict(t).values(), tree_count(model), ratio)
         for i, (t, (model, auc), ratio) in enumerate(zip(trials, found, ratios))], TRIALS_SCHEMA)
    return table.orderBy(F.desc("auc"), "trial"), trials[best], test_auc


def _auc(model, rows: DataFrame, label: str) -> float:
    judge = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)
    return float(judge.evaluate(model.transform(rows)))


def promote(spark: SparkSession, log_path: str, champion_path: str, best: Trial, best_auc: float,
            n_trials: int, model_path: str, run_timestamp) -> bool:
    """Log the best parameters; make the model champion if its AUC is greater than the champion's.

    The champion table is append-only; its newest row is the champion.
    """
    champions = ensure_table(spark, champion_path, schemas.schema_of(
        "promoted_at TIMESTAMP, auc DOUBLE, model_path STRING"))
    current = champions.orderBy(F.desc("promoted_at")).limit(1).first()
    champion_auc = current["auc"] if current else 0.0
    promoted = best_auc > champion_auc
    row = (run_timestamp, n_trials, best_auc, champion_auc, best_auc - champion_auc, promoted, *asdict(best).values())
    append_log(spark.createDataFrame([row], schemas.BEST_PARAMS), log_path, schemas.BEST_PARAMS)
    if promoted:
        append_log(spark.createDataFrame([(run_timestamp, best_auc, model_path)], champions.schema),
                   champion_path, champions.schema)
    return promoted


# --- scoring and run log ---------------------------------------------------------------------

def score_all(model, features: DataFrame, version: str, run_id: str, scored_at) -> DataFrame:
    """Default probability -> score, band and provenance for every row, in the score table's schema."""
    scored = score_tables.credit_scores(default_probability(model.transform(features)))
    return scored.withColumns({
        "score_timestamp": F.lit(scored_at).cast("timestamp"), "model_version": F.lit(version),
        "model_run_id": F.lit(run_id)}).select(*schemas.CREDIT_SCORES.names)


def upsert_scores(current: DataFrame, fresh: DataFrame, scored_users: DataFrame | None = None) -> DataFrame:
    """Replace the scores of the users just scored.  ``scored_users`` (their keys) spares a second model run."""
    return merge_upsert(current, fresh, "user_id", check=scored_users is None, source_keys=scored_users)


def predict_scores(model, features: DataFrame) -> DataFrame:
    """Regressor output as the 11-column prediction table."""
    return score_tables.prediction_table(model.transform(features))


def log_run(spark: SparkSession, path: str, run_name: str, params: dict, metrics: dict, signature: DataFrame) -> None:
    """Parameters, metrics and the input schema of a run as rows of an append-only table."""
    rows = [(run_name, k, "param", str(v)) for k, v in params.items()]
    rows += [(run_name, k, "metric", repr(float(v))) for k, v in metrics.items()]
    rows.append((run_name, "schema", "signature", json.dumps(signature.schema.jsonValue())))
    append_log(spark.createDataFrame(rows, schemas.RUNS), path, schemas.RUNS)
