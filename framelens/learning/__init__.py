"""Features, linear models, calibration and loops that are trained by Spark jobs."""
