"""Classifying new postings with a trained model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.functions.text import company_in_description
from tidepost.operators.frames import union_sources, with_defaults
from tidepost.operators.keywords import keyword_features
from tidepost.operators.rating import attach_ratings
from tidepost.plans.training import TrainedModel, features_of, with_prediction
from tidepost.settings import BIN_WEIGHTS, KEYWORD_BINS


def new_posting_features(sources: Sequence[DataFrame], bins: Mapping[str, Sequence[str]] = KEYWORD_BINS,
                         weights: Mapping[str, float] = BIN_WEIGHTS) -> DataFrame | None:
    """Union of landed sources with the features a model needs; None without any source.

    A missing description counts as an empty one.
    """
    rows = union_sources(sources)
    if rows is None:
        return None
    rows = with_defaults(rows, {"desc": "", "titles": ""})
    if "companies" in rows.columns:
        rows = rows.withColumn("company_in_description",
                               company_in_description(F.col("companies"), F.col("desc")).cast("boolean"))
    return keyword_features(rows, "desc", bins, weights)


def predict(model: TrainedModel, rows: DataFrame) -> DataFrame:
    """The rows with ``prediction`` and ``prediction_probability`` (of class 1)."""
    featured = features_of(model.features, rows, rows.columns)
    return with_prediction(model.classifier, featured, rows.columns) \
        .withColumnRenamed("probability", "prediction_probability")


def predict_and_rate(model: TrainedModel, cities: Mapping[str, DataFrame], replies: DataFrame | None = None,
                     key: str = "job_id") -> DataFrame | None:
    """Predictions per city in one frame, with landed ratings as ``desirability`` where given."""
    rows = union_sources([frame.withColumn("city", F.lit(city)) for city, frame in cities.items()])
    if rows is None:
        return None
    predicted = predict(model, rows)
    if replies is None:
        return predicted
    return attach_ratings(predicted, replies, key).withColumnRenamed("rating", "desirability")
