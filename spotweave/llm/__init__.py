"""Training-data operators: dedup, decontamination, classifiers, mixing, scans.

Nothing outside this subpackage imports it, so it can be removed without
touching the spatial engine.
"""
