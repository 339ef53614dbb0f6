"""Exceptions of the library."""


class GaugelineError(Exception):
    """Base of all errors raised here."""


class EmptyDatasetError(GaugelineError, ValueError):
    """No rows are left to compute from."""


class NonUniformTypeError(GaugelineError, TypeError):
    """An in-memory column mixes types."""


class FacetError(GaugelineError, ValueError):
    """A facet has no rows, or a ratio that a metric needs has a zero denominator."""


class SegmentError(GaugelineError, ValueError):
    """A segmentation criterion is incomplete or contradictory."""


class PayloadTypeError(GaugelineError, TypeError):
    """A segmentation value and its column have different types."""


class InvalidMetricError(GaugelineError, ValueError):
    """A metric name is unknown for the family."""


class InvalidReportError(GaugelineError, ValueError):
    """A report lacks metrics or holds unknown ones."""


class ModelTypeMismatchError(GaugelineError, ValueError):
    """Two performance reports are of different model types."""


class BaselineError(GaugelineError, ValueError):
    """A drift baseline is too small, constant where that is not allowed, or holds NaN."""


class DriftInputError(GaugelineError, ValueError):
    """Drift input cannot be read as the monitor's type."""
