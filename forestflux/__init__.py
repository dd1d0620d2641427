"""A PySpark-native analytics engine for forest-carbon accounting on long-format rasters, lidar shots and polygons."""
