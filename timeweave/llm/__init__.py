"""Training-data operators: filtering, deduplication, mixing, packing and sharding.

Nothing else in the library imports this subpackage.  ``registry`` lists the
queries; every other module holds one operator.
"""
