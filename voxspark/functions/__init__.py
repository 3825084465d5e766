"""voxspark subpackage."""
