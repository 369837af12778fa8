"""Second learner: Spark ML ``HashingTF -> IDF -> LogisticRegression``.

Labels are indexed in sorted order (the same class index as elsewhere) and
rows may carry per-class weights (``class_weights``) as ``weightCol``.
Training is Spark ML's distributed L-BFGS (tree aggregation of gradients).
Every token counts: it is hashed to one of ``features`` dimensions, which fixes
the model's size (classes x features) without a vocabulary on the driver.  The
number of dimensions follows from a sketch of the number of distinct tokens.

Tokens are hashed and weighted once, into a table of sparse vectors on shared
storage; the iterations read that alone.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import shared_table
from ..sources.tables import spread
from .encode import classes_from_data
from .evaluate import class_weights

MIN_FEATURES, MAX_FEATURES = 1 << 12, 1 << 18
TOKENS_PER_FEATURE = 4       # distinct tokens that share a dimension, at most about


def feature_count(train: DataFrame, tokens_col: str) -> int:
    """Dimensions for the distinct tokens (an approximate count, one pass)."""
    distinct = (train.select(F.explode_outer(tokens_col).alias("t"))
                .agg(F.approx_count_distinct("t")).first()[0])
    wanted = 1 << max(0, distinct // TOKENS_PER_FEATURE).bit_length()
    return min(MAX_FEATURES, max(MIN_FEATURES, wanted))


def fit_lr(train: DataFrame, label_col: str, tokens_col: str, *, weighted: bool = True,
           features: int | None = None, max_iter: int = 20,
           reg_param: float = 0.01) -> PipelineModel:
    """``features``: dimensions that tokens are hashed to (default: by their number)."""
    data = train.filter(F.col(label_col).isNotNull()).select(label_col, tokens_col)
    # one pass for the classes (checked for size); they give index and weights
    cls = classes_from_data(data, label_col)
    names = [r.class_name for r in cls.orderBy("class_idx").collect()]
    indexer = StringIndexerModel.from_labels(names, inputCol=label_col, outputCol="_label_idx",
                                             handleInvalid="skip")
    hashing = HashingTF(inputCol=tokens_col, outputCol="_tf",
                        numFeatures=features or feature_count(data, tokens_col))
    hashed = shared_table(hashing.transform(indexer.transform(data))
                          .select(label_col, "_label_idx", "_tf"), "hashed")
    idf = IDF(inputCol="_tf", outputCol="_features").fit(hashed)
    vectors = spread(idf.transform(hashed))
    lr = LogisticRegression(featuresCol="_features", labelCol="_label_idx",
                            predictionCol="_pred_idx", probabilityCol="_prob",
                            rawPredictionCol="_raw", maxIter=max_iter, regParam=reg_param,
                            family="multinomial")
    if weighted:
        w = class_weights(hashed.select(label_col), label_col, cls).select(
            F.col("class_name").alias(label_col), F.col("weight").alias("_w"))
        vectors = vectors.join(F.broadcast(w), label_col)
        lr = lr.setWeightCol("_w")
    return PipelineModel([indexer, hashing, idf, lr.fit(vectors)])


def predict_lr(model: PipelineModel, df: DataFrame, out_col: str = "pred_label") -> DataFrame:
    """``df`` plus the predicted label name (and class index)."""
    indexer = model.stages[0]
    scored = model.transform(df)
    back = IndexToString(inputCol="_pred_idx", outputCol=out_col, labels=indexer.labels)
    out = back.transform(scored)
    drop = [c for c in ("_label_idx", "_tf", "_features", "_raw", "_prob", "_w")
            if c in out.columns and c not in df.columns]
    return out.drop(*drop).withColumn("_pred_idx", F.col("_pred_idx").cast("int")) \
        .withColumnRenamed("_pred_idx", "pred_idx")
