"""Column-level functions: paths, value families, and the value algebra."""
