"""Imputer, scaler and baselines as stages of a Spark ML pipeline, so that a whole fit is saved and loaded as one model.

Each estimator fits the statistics of ``ml/fitted.py`` on the rows it is given and
its model applies them to any rows. Statistics per column are kept as parameters;
baselines, which have a row per entity, as a table beside them.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.ml.fitted import add_baselines, train_baselines
from pulsegrid.plans.quantile import column_quantiles


class _Columns(HasInputCols):
    """Stages that replace their input columns."""

    values = Param(Params._dummy(), "values", "one number per input column", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "one scale per input column", TypeConverters.toListFloat)


class MedianImputer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fills NULLs with the exact median of the rows it is fitted on; a column without values stays as it is."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        cols = self.getInputCols()
        medians = column_quantiles(dataset, cols, {"median": 0.5})
        found = [medians.get(c, {}).get("median") for c in cols]
        model = MedianImputerModel()._resetUid(self.uid)
        return model._set(inputCols=cols, values=[float("nan") if m is None else float(m) for m in found])


class MedianImputerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        known = {c: m for c, m in zip(self.getInputCols(), self.getOrDefault(self.values)) if m == m}
        return dataset.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in known.items()})


class PopulationScaler(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """``(x - mean) / population std`` of the rows it is fitted on; a constant column gives 0."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        row = dataset.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        means = [row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i in range(len(cols))]
        model = PopulationScalerModel()._resetUid(self.uid)
        return model._set(inputCols=cols, values=means, scales=[row[f"s{i}"] or 1.0 for i in range(len(cols))])


class PopulationScalerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        fitted = zip(self.getInputCols(), self.getOrDefault(self.values), self.getOrDefault(self.scales))
        return dataset.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in fitted})


class _Baselines(HasInputCols):
    """Stages that compare columns with an entity's own level."""

    entity = Param(Params._dummy(), "entity", "column that names the entity", TypeConverters.toString)
    suffix = Param(Params._dummy(), "suffix", "what a baseline's name adds to its column's", TypeConverters.toString)

    def names(self) -> dict[str, str]:
        return {c: f"{c}{self.getOrDefault(self.suffix)}" for c in self.getInputCols()}


class EntityBaselines(Estimator, _Baselines, DefaultParamsReadable, DefaultParamsWritable):
    """Mean of each column per entity over the rows it is fitted on; the model adds it with deviation and ratio."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, entity: str | None = None, suffix: str = "_baseline"):
        super().__init__()
        self._setDefault(suffix="_baseline")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> EntityBaselinesModel:
        model = EntityBaselinesModel()._resetUid(self.uid)
        model._set(inputCols=self.getInputCols(), entity=self.getOrDefault(self.entity), suffix=self.getOrDefault(self.suffix))
        model.table = train_baselines(dataset, model.getOrDefault(model.entity), model.names())
        return model


class _WithTable(MLWriter):
    def __init__(self, instance: EntityBaselinesModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        self.instance.table.write.parquet(f"{path}/table")


class _FromTable(MLReader):
    def load(self, path: str) -> EntityBaselinesModel:
        spark = SparkSession.active()
        model = EntityBaselinesModel()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.table = spark.read.parquet(f"{path}/table")
        return model


class EntityBaselinesModel(Model, _Baselines, MLReadable, MLWritable):
    """``table`` has a row per entity of the fitted rows; others get the mean of its rows."""

    table: DataFrame

    def __init__(self):
        super().__init__()
        self._setDefault(suffix="_baseline")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return add_baselines(dataset, self.table, self.getOrDefault(self.entity), self.names())

    def write(self) -> MLWriter:
        return _WithTable(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FromTable()
