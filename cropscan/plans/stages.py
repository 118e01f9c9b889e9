"""The steps of scoring as stages of a Spark ML pipeline, which is fitted, saved and loaded as one.

``Pipeline(stages=[ClearPixels(), VegetationIndices(), MinMaxScaler(...), FieldMask(), VectorAssembler(...), KMeans(...)])``
is the training plan; its model holds the extremes it was fitted with.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropscan.functions.indices import INDICES, with_indices
from cropscan.functions.quality import BRIGHT_LIMIT, clear_pixels, is_inside
from cropscan.operators.clustering import _feature_table
from cropscan.operators.masks import inside_mask
from cropscan.operators.scaling import SCALED_SOURCES, extremes, minmax_scaled, scaled


class _Stage(DefaultParamsReadable, DefaultParamsWritable):
    """Keyword parameters, kept with the stage when it is saved."""

    def _take(self, given: dict) -> None:
        self._set(**{name: value for name, value in given.items() if value is not None})

    def _value(self, name: str):
        return self.getOrDefault(self.getParam(name))


class ClearPixels(Transformer, _Stage):
    """Keeps the pixels below the brightness limit."""

    limit = Param(Params._dummy(), "limit", "brightness from which a pixel is not clear", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, limit: int | None = None):
        super().__init__()
        self._setDefault(limit=BRIGHT_LIMIT)
        self._take(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return clear_pixels(dataset, self._value("limit"))


class VegetationIndices(Transformer, _Stage):
    """Adds index columns."""

    names = Param(Params._dummy(), "names", "indices to add", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, names: list[str] | None = None):
        super().__init__()
        self._setDefault(names=list(INDICES))
        self._take(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return with_indices(dataset, self._value("names"))


class FieldMask(Transformer, _Stage):
    """Keeps the pixels inside the mask: the pixels' own column, or the stored cells or bitmaps at ``path``.

    The path is what is saved; the mask is read when pixels are transformed.
    """

    path = Param(Params._dummy(), "path", "Parquet table of the mask; empty for the mask column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, path: str | None = None):
        super().__init__()
        self._setDefault(path="")
        self._take(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        path = self._value("path")
        return inside_mask(dataset, dataset.sparkSession.read.parquet(path)) if path else dataset.filter(is_inside())


class _Scaling(Params):
    names = Param(Params._dummy(), "names", "what to scale, as named in Scaled_<name>", TypeConverters.toListString)
    scope = Param(Params._dummy(), "scope", "global: by the fitted extremes; scene: by each scene's own", TypeConverters.toString)


class MinMaxScaler(Estimator, _Scaling, _Stage):
    """Learns the extremes that scale pixels; for scope ``scene`` there is nothing to learn."""

    @keyword_only
    def __init__(self, *, names: list[str] | None = None, scope: str | None = None):
        super().__init__()
        self._setDefault(names=list(SCALED_SOURCES), scope="global")
        self._take(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MinMaxScalerModel:
        names, scope = self._value("names"), self._value("scope")
        if scope not in ("global", "scene"):
            raise ValueError(f"unknown scope {scope!r}")
        low, high = [], []
        if scope == "global":
            row = extremes(dataset, names).first()
            bounds = [(row[f"min_{n}"], row[f"max_{n}"]) for n in names]
            if any(a is None for a, _ in bounds):
                raise ValueError("nothing to learn extremes from")
            low, high = ([float(b[k]) for b in bounds] for k in (0, 1))
        return MinMaxScalerModel(names=names, scope=scope, low=low, high=high)


class MinMaxScalerModel(Model, _Scaling, _Stage):
    """Adds Scaled_<name> columns by the extremes it was fitted with, or by each scene's own."""

    low = Param(Params._dummy(), "low", "smallest values, in the order of names", TypeConverters.toListFloat)
    high = Param(Params._dummy(), "high", "largest values, in the order of names", TypeConverters.toListFloat)

    @keyword_only
    def __init__(
        self, *, names: list[str] | None = None, scope: str | None = None, low: list[float] | None = None,
        high: list[float] | None = None,
    ):
        super().__init__()
        self._take(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self._value("names")
        if self._value("scope") == "scene":
            return minmax_scaled(dataset, names)
        bounds = zip(names, self._value("low"), self._value("high"), strict=True)
        return dataset.withColumns({
            f"Scaled_{n}": scaled(F.col(SCALED_SOURCES[n]), F.lit(low), F.lit(high)) for n, low, high in bounds})


class StoredKMeans(KMeans):
    """Spark ML's ``KMeans`` over features that are stored first, alone and once.

    Its seeding passes over its input some seven times, and would run the stages before it as often. A plan that is
    saved before it is fitted comes back with plain ``KMeans``. Of the model's summary only figures stay.
    """

    def _fit(self, dataset: DataFrame) -> KMeansModel:
        weight = [self.getWeightCol()] if self.isDefined(self.weightCol) and self.getWeightCol() else []
        with _feature_table(dataset, [self.getFeaturesCol(), *weight]) as table:
            return super()._fit(table)
