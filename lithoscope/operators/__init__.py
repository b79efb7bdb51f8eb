"""DataFrame operators: spectra, structures, matching, statistics, resampling and models."""
