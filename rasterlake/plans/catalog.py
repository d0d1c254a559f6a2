"""All query modules; importing them fills the registry."""

from rasterlake.operators import app_queries, calibration_queries, color_queries, denoise_queries, develop_queries, film_queries, lens_queries, library_queries, lookup_queries, ordered_queries, pyramid_queries, resample_queries, stats_queries, stencil_queries  # noqa: F401
from rasterlake.plans.registry import ORACLE, QUERIES  # noqa: F401
from rasterlake.sources import formats, tiff, x3f  # noqa: F401
from rasterlake.streaming import requests, sessions  # noqa: F401
