"""Lithoscope: Spark-first analytics for spectral, structural and statistical feature tables."""
