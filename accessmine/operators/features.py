"""Feature encodings and a split that doesn't depend on partitions."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ATTRIBUTES = ("position", "department", "location", "contract_type", "seniority")


def multi_hot(lists: DataFrame, out: str = "labels"):
    """Model and frame with a sparse 0/1 vector over the permissions that occur."""
    words = lists.withColumn("_words", F.transform("permissions", lambda p: p.cast("string")))
    # a place for every permission: the default keeps the 262,144 most frequent ones
    n = max(1, words.select(F.explode("_words").alias("w")).agg(F.countDistinct("w")).first()[0])
    model = CountVectorizer(vocabSize=n, inputCol="_words", outputCol=out, binary=True).fit(words)
    return model, model.transform(words).drop("_words")


def label_codes(users: DataFrame, column: str) -> DataFrame:
    """(value, code): codes from 0 in sorted order."""
    values = users.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct()
    return values.withColumn("code", F.row_number().over(Window.orderBy("value")).cast("long") - 1)


def encoder(columns: tuple[str, ...] = ATTRIBUTES, out: str = "features") -> Pipeline:
    """One-hot vectors of the columns; an unknown value is all zeros."""
    index = StringIndexer(inputCols=list(columns), outputCols=[f"_{c}_i" for c in columns], stringOrderType="alphabetAsc", handleInvalid="keep")
    hot = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"_{c}_v" for c in columns], dropLast=True)
    return Pipeline(stages=[index, hot, VectorAssembler(inputCols=hot.getOutputCols(), outputCol=out)])


def train_test_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key."""
    test = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    return df.where(~test), df.where(test)
