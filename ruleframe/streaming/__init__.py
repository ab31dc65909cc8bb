"""Change streams, throttling and running metrics."""
