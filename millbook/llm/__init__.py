"""Operators of a training-data pipeline: dedup, mixing, filters, scans, sharding, packing.

One module per operator, each with its own general interface; ``queries``
binds them to the driver's tables. Nothing else in the library imports this
package.
"""
