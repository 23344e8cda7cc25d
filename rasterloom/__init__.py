"""Raster radiometry and training-data operators as Spark DataFrame plans."""
