"""odweave: origin-destination matrix and network analytics as Spark DataFrame functions."""
