"""stratafold: region analytics over labelled points, polygons and rasters, written as Spark DataFrame functions."""
