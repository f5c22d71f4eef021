"""Operators for preparing training data; nothing else in siftlake imports this package."""
