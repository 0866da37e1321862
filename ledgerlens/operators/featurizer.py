"""Featurizer protocol (fit on train, transform any split, save/load) as an ML
``Estimator``/``Model`` pair, so it composes in a ``Pipeline``.

Fitted state (means, stds, vocabularies) is stored as JSON string params, which
the default ML writer persists; ``transform`` is one projection with literals.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import prep


class _FeaturizerParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns to scale", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "columns to one-hot", TypeConverters.toListString)
    keepCols = Param(Params._dummy(), "keepCols", "columns passed through", TypeConverters.toListString)
    zeroFill = Param(Params._dummy(), "zeroFill", "nulls count as 0 (chunked form)", TypeConverters.toBoolean)
    maxLevels = Param(Params._dummy(), "maxLevels", "vocabulary size bound", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], keepCols=[], zeroFill=False, maxLevels=10_000)


class TxnFeaturizer(Estimator, _FeaturizerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, numericCols=None, categoricalCols=None, keepCols=None, zeroFill=False, maxLevels=10_000):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "TxnFeaturizerModel":
        zf = self.getOrDefault(self.zeroFill)
        p, vocab = prep.fit_scale_and_vocab(df, self.getOrDefault(self.numericCols),
                                            self.getOrDefault(self.categoricalCols), zero_fill=zf,
                                            std_floor=1e-12 if zf else None,
                                            max_levels=self.getOrDefault(self.maxLevels))
        m = TxnFeaturizerModel(keepCols=self.getOrDefault(self.keepCols), zeroFill=zf,
                               scaleJson=json.dumps({"mean": p.mean, "std": p.std}),
                               vocabJson=json.dumps(vocab))
        return self._copyValues(m)


class TxnFeaturizerModel(Model, _FeaturizerParams, DefaultParamsReadable, DefaultParamsWritable):
    scaleJson = Param(Params._dummy(), "scaleJson", "fitted mean/std", TypeConverters.toString)
    vocabJson = Param(Params._dummy(), "vocabJson", "fitted vocabularies", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, keepCols=None, zeroFill=False, scaleJson="{}", vocabJson="{}"):
        super().__init__()
        self._setDefault(scaleJson="{}", vocabJson="{}")
        self._set(**self._input_kwargs)

    def scale_params(self) -> prep.ScaleParams:
        j = json.loads(self.getOrDefault(self.scaleJson))
        return prep.ScaleParams(mean=j.get("mean", {}), std=j.get("std", {}))

    def vocabulary(self) -> dict[str, list[str]]:
        return json.loads(self.getOrDefault(self.vocabJson))

    def feature_names(self) -> list[str]:
        return list(self.scale_params().mean) + [f"{c}__{lv}" for c, lvs in self.vocabulary().items() for lv in lvs]

    def _transform(self, df: DataFrame) -> DataFrame:
        keep = [F.col(c) for c in self.getOrDefault(self.keepCols) if c in df.columns]
        return df.select(*keep, *prep.scale_exprs(self.scale_params(), zero_fill=self.getOrDefault(self.zeroFill)),
                         *prep.onehot_exprs(self.vocabulary()))
