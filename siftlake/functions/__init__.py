"""Part of siftlake."""
