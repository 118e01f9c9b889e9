from . import clustering, harvest, joins, lots, masks, quantiles, raster, scaling, scenes, timeseries

__all__ = [
    "clustering", "harvest", "joins", "lots", "masks", "quantiles", "raster", "scaling",
    "scenes", "timeseries",
]
