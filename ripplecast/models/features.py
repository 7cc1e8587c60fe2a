"""Encodings, scaling and the feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns each encoding covers, and the scaled ones.
ONE_HOT = [
    "day_phase", "day_of_week", "month", "year", "topics_cleaned", "sentiment", "verified",
    "hashtags",
]
LABELLED = ["day_phase", "day_of_week", "month", "year", "sentiment", "verified", "hashtags"]
NUMERIC = ["followers", "following", "tweet_count", "seniority"]
CATEGORICAL = [
    "topics", "sentiment", "hashtags", "verified", "day_phase", "day_of_week", "month",
]
NOT_ENCODED = ["topics_ids", "topics_cleaned"]

VOCABULARY_LIMIT = 1000
LABEL = "popularity"


def vocabularies(
    df: DataFrame, columns: Sequence[str], limit: int = VOCABULARY_LIMIT
) -> dict[str, list]:
    """Sorted values per column, a null last; refuses columns that are no vocabularies."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    distinct = df.select(F.explode(cells).alias("cell")).select("cell.*").distinct()
    rows = distinct.limit(limit * len(columns) + 1).collect()
    found: dict[str, list] = {column: [] for column in columns}
    for row in rows:
        found[row["column"]].append(row["value"])
    for column, values in found.items():
        if len(values) > limit:
            raise ValueError(f"{column} has more than {limit} values")
        parse = _parser(df.schema[column].dataType)
        known = sorted(parse(value) for value in values if value is not None)
        found[column] = known + [None] * (None in values)
    return found


def _parser(kind: T.DataType):
    if isinstance(kind, T.BooleanType):
        return lambda text: text == "true"
    if isinstance(kind, T.IntegralType):
        return int
    return str


def one_hot(df: DataFrame, vocabulary: dict[str, list]) -> DataFrame:
    """Add a 0/1 column per value but the first of every vocabulary, null being a value."""
    added = {}
    for column, values in vocabulary.items():
        for value in values[1:]:
            added[f"{column}_{value}"] = F.col(column).eqNullSafe(F.lit(value)).cast("int")
    return df.withColumns(added)


def label_encode(df: DataFrame, vocabulary: dict[str, list]) -> DataFrame:
    """Add ``<column>_enc``, the place of the value in its sorted vocabulary."""
    added = {}
    for column, values in vocabulary.items():
        place = F
        for i, value in enumerate(values):
            place = place.when(F.col(column).eqNullSafe(F.lit(value)), F.lit(i))
        added[f"{column}_enc"] = place
    return df.withColumns(added)


def encode(df: DataFrame) -> DataFrame:
    """Both encodings, fitted once over all years."""
    found = vocabularies(df, ONE_HOT)
    return label_encode(one_hot(df, found), {c: found[c] for c in LABELLED})


def encoded_columns(df: DataFrame) -> list[str]:
    """Columns that hold a 0/1 encoding of a categorical one."""
    return [
        name
        for prefix in CATEGORICAL
        for name in df.columns
        if name.startswith(prefix)
        and not name.endswith("_enc")
        and name not in CATEGORICAL
        and name not in NOT_ENCODED
    ]


def clean_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0, list(columns))


def split_by_last_year(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of all years but the last, and of the last."""
    last = df.agg(F.max("year")).scalar()
    marked = df.withColumn("_last", last)
    train = marked.where(F.col("year") < F.col("_last")).drop("_last")
    return train, marked.where(F.col("year") == F.col("_last")).drop("_last")


def split_xy(df: DataFrame, label: str = LABEL, key: str = "tweet_id") -> tuple[DataFrame, DataFrame]:
    """Features and labels, tied by the key."""
    return df.drop(label), df.select(key, label)


def scaling(train: DataFrame, columns: Sequence[str] = NUMERIC) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, from one aggregate row."""
    row = train.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
    ).first()
    return {c: (row[f"{c}_mean"], row[f"{c}_std"] or 1.0) for c in columns}


def standardize(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    """Replace each column by its z-score under a fitted scaling."""
    return df.withColumns(
        {c: (F.col(c) - F.lit(mean)) / F.lit(std) for c, (mean, std) in scale.items()}
    )


def assemble_features(
    df: DataFrame, columns: Sequence[str], label: str = LABEL, key: str = "tweet_id"
) -> DataFrame:
    """(key, label, features) with the named columns as one vector."""
    as_doubles = [F.col(c).cast("double").alias(c) for c in columns]
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    chosen = df.select(key, F.col(label).cast("int").alias(label), *as_doubles)
    return assembler.transform(chosen).select(key, label, "features")


def feature_value(index: int) -> Column:
    """One element of the ``features`` vector, without Python."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array("features")[index]
