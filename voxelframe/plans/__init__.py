"""All queries of the library."""

from . import catalogue, datasets, images, modelling, relational, spatial, statistics  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
