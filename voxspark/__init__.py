"""voxspark: DataFrame operators for volumetric grids and the tables around them."""
