"""Training-data operators: search, decontamination, tokens, dedup, classifiers, licences.

Nothing else in the library imports this subpackage; the registered queries
are in :mod:`riskweave.llm.registry`.
"""
