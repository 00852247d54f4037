"""Training-data operators: secrets, deduplication, mixing, licences, language, packing, quality.

Nothing else in the package imports this subpackage.
"""
