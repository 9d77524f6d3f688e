"""Relations between regions (disjoint, overlapping, nested, empty), proved on the driver in exact arithmetic.

The prover never touches bulk data; Spark checks its verdicts empirically (``crosstab``).
"""
