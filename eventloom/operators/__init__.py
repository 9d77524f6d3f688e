"""What a run computes: membership, cutflows, bin flows and histograms."""

from .bins import bin_flow
from .cutflow import cutflow
from .histograms import fills, histograms
from .membership import accepted, counts, membership

__all__ = ["accepted", "bin_flow", "counts", "cutflow", "fills", "histograms", "membership"]
