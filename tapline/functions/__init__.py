"""tapline subpackage."""
