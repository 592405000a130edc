"""Files that results are published to."""
