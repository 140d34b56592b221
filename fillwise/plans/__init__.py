"""Registered queries. Importing the package registers all of them."""

from fillwise.plans import grids, models, series, station_days, validation  # noqa: F401
