"""The sanitiser, the preprocessor and TF-IDF as pyspark.ml stages, for use in a Pipeline."""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import functions as F

from ..functions.text import sanitize, tokens, unigrams_bigrams
from .features import Preprocessor, vocabulary

#: Terms of a vocabulary that a fitted model may hold in the driver and its plan.
MAX_TERMS = 20_000


class LeakSanitizer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """outputCol: the text of inputCol without target leaks."""

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "clean"):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="clean")
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        return dataset.withColumn(self.getOutputCol(), sanitize(F.col(self.getInputCol())))


class FeatureEncoder(Estimator, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a Preprocessor on its table: numeric medians and scales, levels of categories."""
    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categorical columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, numeric: list[str] = (), categorical: list[str] = (), outputCol: str = "x"):
        super().__init__()
        self._setDefault(numeric=[], categorical=[], outputCol="x")
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        p = Preprocessor(list(self.getOrDefault("numeric")), list(self.getOrDefault("categorical"))).fit(dataset)
        return self._copyValues(FeatureEncoderModel(p))


class _TableWriter(MLWriter):
    """Writes a fitted model: its parameters as metadata, what it learnt as a Parquet table."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.learnt(self.sparkSession).coalesce(1).write.parquet(f"{path}/data")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        found = self.cls.from_learnt(self.sparkSession.read.parquet(f"{path}/data"))
        found._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(found, metadata)
        return found


class _Persistent(MLWritable, MLReadable):
    """A model with learnt(), a small table of what it holds, and from_learnt(), its inverse."""

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class FeatureEncoderModel(Model, HasOutputCol, _Persistent):
    """outputCol: an array of double of all features; other columns stay."""

    def __init__(self, preprocessor: Preprocessor):
        super().__init__()
        self.preprocessor = preprocessor

    def _transform(self, dataset):
        return self.preprocessor.vector(dataset, dataset.columns, self.getOutputCol())

    def learnt(self, spark):
        return spark.createDataFrame([(json.dumps(asdict(self.preprocessor)),)], "preprocessor string")

    @classmethod
    def from_learnt(cls, table):
        return cls(Preprocessor(**json.loads(table.first().preprocessor)))


class SafeTfidf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the vocabulary of sanitised uni- and bigrams on its table alone."""
    maxFeatures = Param(Params._dummy(), "maxFeatures", "most frequent terms to keep", TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "documents that must hold a term", TypeConverters.toInt)
    sparse = Param(Params._dummy(), "sparse", "whether outputCol is a struct of size, indices and values", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "tfidf", maxFeatures: int = 5000, minDF: int = 1, sparse: bool = False):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="tfidf", maxFeatures=5000, minDF=1, sparse=False)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        most = self.getOrDefault("maxFeatures")
        if not 0 < most <= MAX_TERMS:
            raise ValueError(f"1 to {MAX_TERMS} features")
        clean = dataset.select(sanitize(F.col(self.getInputCol())).alias("text"))
        terms = vocabulary(clean, "text", most, self.getOrDefault("minDF")).select("term", "idf").orderBy("term").collect()  # at most MAX_TERMS
        return self._copyValues(SafeTfidfModel([(r.term, r.idf) for r in terms]))


class SafeTfidfModel(Model, HasInputCol, HasOutputCol, _Persistent):
    """outputCol: of each row the weights of the terms, in order, of unit length (or all zero): an array
    of double, or if sparse is set a struct of size, indices and values. An empty vocabulary gives one column of zeros.
    Unknown terms don't count. Terms are cut in the JVM and looked up in Arrow batches, so the work is
    that of a row's own terms."""
    sparse = Param(Params._dummy(), "sparse", "whether outputCol is a struct of size, indices and values", TypeConverters.toBoolean)

    def __init__(self, terms: list[tuple[str, float]]):
        super().__init__()
        self._setDefault(sparse=False)
        self.terms = terms
        self.empty_vocabulary = not terms

    def _transform(self, dataset):
        out, wide = self.getOutputCol(), max(1, len(self.terms))
        held = dataset.sparkSession.sparkContext.broadcast({t: (i, w) for i, (t, w) in enumerate(self.terms)})

        def weights(terms) -> tuple[list[int], list[float]]:
            known = held.value
            found = sorted((known[t][0], (1 + math.log(n)) * known[t][1]) for t, n in Counter(terms).items() if t in known)
            norm = math.sqrt(sum(w * w for _, w in found))
            return [i for i, _ in found], [w / norm for _, w in found]

        @F.pandas_udf("array<double>")
        def dense(column: pd.Series) -> pd.Series:
            rows = []
            for terms in column:
                row = np.zeros(wide)
                i, w = weights(terms)
                row[i] = w
                rows.append(row)
            return pd.Series(rows, dtype=object)

        @F.pandas_udf("size int, indices array<int>, values array<double>")
        def entries(column: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([(wide, *weights(terms)) for terms in column], columns=["size", "indices", "values"])

        words = dataset.withColumn("__w", tokens(sanitize(F.col(self.getInputCol()))))
        return words.withColumn(out, (entries if self.getOrDefault("sparse") else dense)(unigrams_bigrams(F.col("__w")))).drop("__w")

    def learnt(self, spark):
        return spark.createDataFrame([(i, t, float(w)) for i, (t, w) in enumerate(self.terms)], "place int, term string, idf double")

    @classmethod
    def from_learnt(cls, table):
        return cls([(r.term, r.idf) for r in table.orderBy("place").collect()])
