"""Column functions: expressions, geometry arrays, geodesy."""
