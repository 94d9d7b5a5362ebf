"""Model training with MLlib (ML3-ML7, DQ19, AG14).

Every estimator is fit on the train split only; folds come from an integer
hash of the key (a ``foldCol``), classes are balanced with a weight column,
learners are compared by cross-validated AUC, the winner is tuned on a small
grid and kept only if better, then calibrated with isotonic regression on
out-of-fold scores.  Scores for all customers come from one ``transform``.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import key_number
from . import metrics as M
from .features import check_no_rfm, split_hash

# ---- fixed values (must equal the reference's) -------------------------------
IMPORTANCE_SHARE = 0.98
MIN_FEATURES = 5
AGREEMENT_STD = 0.03
AGREEMENT_TOP = 5
# ------------------------------------------------------------------------------

SEED = 123
MAX_CLASSES = 100
#: rows of a training table that one task reads; a learner runs hundreds of short stages over them
TASK_ROWS = 50_000
#: most fits that run at a time; see ``fits_at_a_time``
PARALLEL_FITS = 8
#: tasks a core that fits at a time should offer together
TASKS_A_CORE = 4


def add_folds(df: DataFrame, key: str, k: int, name: str = "fold") -> DataFrame:
    """Fold number from the key's hash; the key may be a number or text."""
    return df.withColumn(name, (split_hash(key_number(df, key), 7) % F.lit(k)).cast("int"))


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weights n / (2 n_class) (default for ML3)."""
    c = {r[label]: r["count"] for r in df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()}
    if len(c) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    n = sum(c.values())
    w = F.create_map(*[x for k_, v in c.items() for x in (F.lit(k_), F.lit(n / (2.0 * v)))])
    return df.withColumn(name, w[F.col(label)])


def feature_stages(numeric: list[str], categorical: list[str]) -> tuple[list, list[str]]:
    """Median imputation, one-hot with the first sorted level dropped
    (alphabetical-descending index + dropLast), one assembled vector."""
    imp = [f"{c}__imp" for c in numeric]
    stages = [Imputer(inputCols=numeric, outputCols=imp, strategy="median")] if numeric else []
    oh = []
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                                 stringOrderType="alphabetDesc"),
                   OneHotEncoder(inputCol=f"{c}__idx", outputCol=f"{c}__oh", dropLast=True,
                                 handleInvalid="keep")]
        oh.append(f"{c}__oh")
    stages.append(VectorAssembler(inputCols=imp + oh, outputCol="features",
                                  handleInvalid="keep"))
    return stages, imp + oh


def learners(label: str, weight: str) -> dict:
    return {
        "Logistic Regression": LogisticRegression(labelCol=label, weightCol=weight, maxIter=50),
        "Ridge Logistic Regression": LogisticRegression(labelCol=label, weightCol=weight,
                                                        maxIter=50, regParam=0.1,
                                                        elasticNetParam=0.0),
        "Random Forest": RandomForestClassifier(labelCol=label, weightCol=weight, numTrees=40,
                                                maxDepth=6, seed=SEED),
        "Gradient Boosted Trees": GBTClassifier(labelCol=label, weightCol=weight, maxIter=20,
                                                maxDepth=4, seed=SEED),
    }


def positive_score(df: DataFrame, out: str = "score") -> DataFrame:
    """Positive-class probability as a plain column (ML7)."""
    return df.withColumn(out, vector_to_array(F.col("probability"))[1])


def laid_out(df: DataFrame, key: str) -> DataFrame:
    """The table in tasks of about ``TASK_ROWS`` rows, by key: learners run hundreds of stages over
    it, which a session's shuffle partitions would cut into tasks of a few rows.  The layout
    depends on the rows alone, so a learner's draws do too."""
    tasks = max(1, math.ceil(df.count() / TASK_ROWS))
    return df.repartition(tasks, F.col(f"`{key}`")).sortWithinPartitions(f"`{key}`")


def prepare(train: DataFrame, others: list[DataFrame], numeric: list[str],
            categorical: list[str], key: str) -> tuple[PipelineModel, DataFrame, list[DataFrame]]:
    """Fit imputation and encoding once on the train split; every later fit
    (folds, tuning, calibration) reuses the cached feature vectors, without the columns
    that they were assembled from."""
    stages, made = feature_stages(numeric, categorical)
    train = train.cache()
    prep = Pipeline(stages=stages).fit(train)
    vec = prep.transform(laid_out(train, key))
    check_no_rfm([a["name"] for group in vec.schema["features"].metadata.get("ml_attr", {}).get(
        "attrs", {}).values() for a in group])
    vec = vec.drop(*numeric, *categorical, *made, *[f"{c}__idx" for c in categorical]).cache()
    vec.count()
    train.unpersist()
    return prep, vec, [prep.transform(o) for o in others]


def at_once(spark, jobs: list[Callable], most: int = PARALLEL_FITS) -> list:
    """Results of independent jobs, ``most`` of which run at a time, in their order."""
    pool, carried = ThreadPool(max(1, min(most, len(jobs)))), inheritable_thread_target(spark)
    try:
        return pool.map(lambda job: carried(job)(), jobs, chunksize=1)
    finally:
        pool.close()


def fits_at_a_time(tasks: int, cores: int) -> int:
    """Fits that fill the cores with stages of ``tasks`` tasks, two at least so that one runs while
    the other waits for its last task.  Every fit holds a copy of its rows, so more than that
    only takes memory: a table of many tasks is fit by few at a time."""
    return max(2, min(PARALLEL_FITS, math.ceil(TASKS_A_CORE * cores / max(1, tasks))))


def fit_at_once(train: DataFrame, jobs: list[Callable]) -> list:
    """Results of fits on ``train`` or parts of it, as many at a time as its tasks leave room for."""
    spark = train.sparkSession
    return at_once(spark, jobs, fits_at_a_time(train.rdd.getNumPartitions(),
                                               spark.sparkContext.defaultParallelism))


def fold_parts(train: DataFrame, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """(rows of the other folds, rows of the fold) for every fold; neither may be empty."""
    n = {r["fold"]: r["count"] for r in train.groupBy("fold").count().limit(folds + 1).collect()}
    for k in range(folds):
        if not n.get(k) or n[k] == sum(n.values()):
            raise ValueError(f"fold {k} leaves nothing to train on or to validate with")
    return [(train.where(F.col("fold") != k), train.where(F.col("fold") == k)) for k in range(folds)]


def cut_forest(model: RandomForestClassificationModel, depth: int) -> RandomForestClassificationModel:
    """The forest that the same fit gives with ``maxDepth`` = ``depth``, from a deeper one.

    MLlib grows all trees level by level and draws a node's features in that order, so the first
    levels do not depend on how many follow (see ``level_by_level``).  Nodes at ``depth`` become
    leaves, and two leaves of one class become one, as in MLlib's own last step."""
    jvm, gateway = SparkContext._active_spark_context._jvm, SparkContext._active_spark_context._gateway
    ml, java = jvm.org.apache.spark.ml, model._java_obj

    def cut(node, levels: int):
        if not node.subtreeDepth():
            return node
        if levels:
            a, b = cut(node.leftChild(), levels - 1), cut(node.rightChild(), levels - 1)
            if a.subtreeDepth() or b.subtreeDepth() or a.prediction() != b.prediction():
                return ml.tree.InternalNode(node.prediction(), node.impurity(), node.gain(), a, b, node.split(),
                                            node.impurityStats())
        return ml.tree.LeafNode(node.prediction(), node.impurity(), node.impurityStats())

    trees = java.trees()
    out = gateway.new_array(ml.classification.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        out[i] = ml.classification.DecisionTreeClassificationModel(
            tree.uid(), cut(tree.rootNode(), depth), tree.numFeatures(), tree.numClasses())
    forest = ml.classification.RandomForestClassificationModel(
        f"{java.uid()}_{depth}", out, java.numFeatures(), java.numClasses())
    return RandomForestClassificationModel(java.copyValues(forest, ml.param.ParamMap.empty()))


def level_by_level(est, params: dict, model) -> bool:
    """Whether the counts of the widest level of all trees fit in the memory of one of MLlib's groups of
    nodes, so that every level was grown at once."""
    has = est.extractParamMap(params)
    nodes = has[est.numTrees] * 2 ** (has[est.maxDepth] - 1)
    counts = model.numFeatures * has[est.maxBins] * (model.numClasses + 1)
    return nodes * counts * 8 <= has[est.maxMemoryInMB] * 2 ** 20


def nested(candidates: list) -> list[list[int]]:
    """Places of the candidates that one fit serves, the deepest first: forests of one estimator that
    differ in depth only.  Any other candidate stands alone."""
    groups: dict = {}
    for i, (est, params) in enumerate(candidates):
        forest = isinstance(est, RandomForestClassifier)
        rest = frozenset((p.name, v) for p, v in params.items() if p.name != "maxDepth") if forest else i
        groups.setdefault((id(est), rest), []).append(i)
    return [sorted(group, key=lambda i: -candidates[i][0].extractParamMap(candidates[i][1]).get(
        getattr(candidates[i][0], "maxDepth", None), 0)) for group in groups.values()]


def cross_validate(candidates: list, train: DataFrame, label: str, folds: int) -> list[float]:
    """Mean AUC over the folds of every candidate (estimator, parameters).

    Fits are independent, so all candidates and folds share one pool; a cross validator of MLlib
    runs the folds of one candidate one after the other.  Forests that differ in depth only are fit
    once, at the greatest depth, and cut."""
    ev = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    parts, groups = fold_parts(train, folds), nested(candidates)

    def one(group, others, own):
        def job():
            est, deepest = candidates[group[0]]
            model, out = est.fit(others, deepest), []
            for i in group:
                params = candidates[i][1]
                if i == group[0]:
                    at = model
                elif level_by_level(est, deepest, model):
                    at = cut_forest(model, est.extractParamMap(params)[est.maxDepth])
                else:
                    at = est.fit(others, params)
                out.append(ev.evaluate(at.transform(own)))
            return out
        return job

    aucs = fit_at_once(train, [one(group, *part) for group in groups for part in parts])
    mean = {}
    for g, group in enumerate(groups):
        for k, i in enumerate(group):
            mean[i] = sum(by_fold[k] for by_fold in aucs[g * folds:(g + 1) * folds]) / folds
    return [mean[i] for i in range(len(candidates))]


def compare(train: DataFrame, label: str, folds: int) -> list[dict]:
    """Cross-validated AUC of every learner on the same folds (ML4)."""
    each = learners(label, "weight")
    aucs = cross_validate([(est, {}) for est in each.values()], train, label, folds)
    models = fit_at_once(train, [lambda est=est: est.fit(train) for est in each.values()])
    return [{"name": name, "cv_auc": float(auc), "model": model, "estimator": est}
            for (name, est), auc, model in zip(each.items(), aucs, models)]


def holdout_row(model, test: DataFrame, label: str, name: str, cv_auc: float,
                key: str) -> tuple:
    s = positive_score(model.transform(test)).select(key, label, "score")
    c = M.confusion(s, label, "score", 0.5, strict=True).first()
    return (name, cv_auc, float(c["accuracy"]), M.auc(s, label, "score"), float(c["recall"]),
            float(c["precision"]), float(c["f1"]))


def tune(best: dict, train: DataFrame, label: str, folds: int) -> tuple[PipelineModel, float, bool]:
    """Small grid on the winner; keep it only when the CV AUC improves (ML5).

    The winner's own parameters are a point of the grid: its AUC on these folds is ``best["cv_auc"]``."""
    est = best["estimator"]
    if isinstance(est, LogisticRegression):
        param, values = est.regParam, [0.0, 0.01, 0.1]
    elif isinstance(est, RandomForestClassifier):
        param, values = est.maxDepth, [4, 6, 8]
    else:
        param, values = est.maxDepth, [3, 4, 5]
    own = est.getOrDefault(param)
    rest = [v for v in values if v != own]
    aucs = dict(zip(rest, cross_validate([(est, {param: v}) for v in rest], train, label, folds)))
    value = max(rest, key=aucs.get)
    if aucs[value] > best["cv_auc"]:
        return est.fit(train, {param: value}), aucs[value], True
    return best["model"], best["cv_auc"], False


def out_of_fold_scores(best: dict, train: DataFrame, label: str, folds: int, key: str) -> DataFrame:
    """Score each fold with a model fit on the other folds."""
    parts = fold_parts(train, folds)
    fitted = fit_at_once(train, [lambda others=others: best["estimator"].fit(others) for others, _ in parts])
    parts = [positive_score(m.transform(own)).select(key, label, "score")
             for m, (_, own) in zip(fitted, parts)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


CALIBRATION_CELLS = 1000


def score_cell(score: Column, cells: int) -> Column:
    """Cell of a probability on a grid of equal steps; 1 belongs to the last."""
    inside = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * cells)
    return F.least(inside, F.lit(cells - 1)).cast("int")


def grid_counts(df: DataFrame, score: str, label: str, cells: int) -> DataFrame:
    """cell, n, positives of the cells that have rows (map-side combined)."""
    return df.where(F.col(score).isNotNull()).groupBy(score_cell(F.col(score), cells).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("positives"))


def pool_adjacent(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(first cell, last cell, n, positives) of the blocks of an isotonic fit to (cell, n,
    positives): neighbours whose rates do not rise are pooled, compared as whole numbers."""
    blocks: list[tuple[int, int, int, int]] = []
    for cell, n, pos in sorted(rows):
        block = (cell, cell, n, pos)
        while blocks and blocks[-1][3] * block[2] >= block[3] * blocks[-1][2]:
            before = blocks.pop()
            block = (before[0], block[1], before[2] + block[2], before[3] + block[3])
        blocks.append(block)
    return blocks


class IsotonicGrid:
    """Isotonic map from score to observed rate, fitted to the counts on a fixed grid (ML6): only
    the grid's cells reach the driver, however many rows were scored.  A cell without rows
    has the rate of the block below it (of the first block, if none is)."""

    def __init__(self, rows: list[tuple[int, int, int]], cells: int = CALIBRATION_CELLS):
        if not rows:
            raise ValueError("nothing to calibrate on")
        self.cells, self.blocks = cells, pool_adjacent(rows)
        self.rates, at = [], 0
        for cell in range(cells):
            while at + 1 < len(self.blocks) and self.blocks[at + 1][0] <= cell:
                at += 1
            self.rates.append(self.blocks[at][3] / self.blocks[at][2])

    def calibrate(self, score: Column) -> Column:
        rates = F.array(*map(F.lit, self.rates))
        return F.when(score.isNotNull(), F.element_at(rates, score_cell(score, self.cells) + 1))


def isotonic(scored: DataFrame, label: str, score: str = "score",
             cells: int = CALIBRATION_CELLS) -> IsotonicGrid:
    """Isotonic map from score to observed rate (ML6)."""
    rows = grid_counts(scored, score, label, cells).collect()          # ``cells`` at most
    return IsotonicGrid([(r["cell"], r["n"], r["positives"]) for r in rows], cells)


def importances(model, train: DataFrame) -> list[tuple[str, float]]:
    """Tree importances mapped back to input names via the vector metadata."""
    if not hasattr(model, "featureImportances"):
        return []
    vec = model.featureImportances.toArray()
    attrs = train.schema["features"].metadata.get("ml_attr", {})
    names = {}
    for group in attrs.get("attrs", {}).values():
        for a in group:
            names[a["idx"]] = a["name"]
    return [(names.get(i, f"f{i}"), float(v)) for i, v in enumerate(vec)]


def select_by_importance(imp: list[tuple[str, float]]) -> list[tuple[str, float, float, bool]]:
    """Keep features until 98 % cumulative importance, at least 5 (DQ19)."""
    imp = sorted(imp, key=lambda t: (-t[1], t[0]))
    total = sum(v for _, v in imp) or 1.0
    cum, rows = 0.0, []
    for name, v in imp:
        cum += v
        rows.append((name, v, cum / total))
    keep_n = max(MIN_FEATURES, min(sum(1 for r in rows if r[2] <= IMPORTANCE_SHARE) + 1, len(rows)))
    return [(n, v, c, i < keep_n) for i, (n, v, c) in enumerate(rows)]


def agreement(aucs: list[float]) -> tuple[float | None, bool]:
    """Std of AUC over the top 5 models with AUC > 0.5 (AG14)."""
    top = sorted([a for a in aucs if a is not None and a > 0.5], reverse=True)[:AGREEMENT_TOP]
    if len(top) < 2:
        return None, False
    sd = statistics.stdev(top)
    return sd, sd < AGREEMENT_STD
