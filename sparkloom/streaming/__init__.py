"""Running sums over a stream."""
