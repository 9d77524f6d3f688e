"""Runs over a stream of events.

Everything that a plan adds is row-local, so membership and accepted events work on a
streaming DataFrame as they are. Cutflows, bin flows and histograms are additive partial results:
``accumulate`` writes those of each batch, once however often the batch is retried, into a log that it
compacts; ``current_..`` sum them.
"""

from .incremental import accumulate, current_bins, current_cells, current_cutflow, numbered_stream, store_batch

__all__ = ["accumulate", "current_bins", "current_cells", "current_cutflow", "numbered_stream", "store_batch"]
