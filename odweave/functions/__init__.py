"""odweave subpackage."""
