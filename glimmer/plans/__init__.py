"""Registered queries; importing the modules registers them."""

from glimmer.plans import choose, judge, measure, scalar, scans  # noqa: F401
