"""Every geometry query of the library, gathered from the modules that define them."""

from planewright.plans import curve_queries as _curve
from planewright.plans import kernel_queries as _kernel
from planewright.plans import more_queries as _more
from planewright.plans import operator_queries as _operator
from planewright.plans import primitive_queries as _primitive
from planewright.plans import queries as _queries
from planewright.plans import shape_queries as _shape
from planewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "_curve", "_kernel", "_more", "_operator", "_primitive", "_queries", "_shape"]
