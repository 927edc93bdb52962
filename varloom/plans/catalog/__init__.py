"""Registered queries over the driver tables, grouped by kind of operator."""

from varloom.plans.catalog import (  # noqa: F401
    expressions,
    files,
    learning,
    order,
    relations,
    statistics,
)
