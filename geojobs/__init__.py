"""Spark jobs for geospatial 3D tiling: vector features, point clouds, meshes, tile trees and their catalog."""

import sys

from pyspark import cloudpickle

# Helpers that run in Python workers travel with their tasks: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
