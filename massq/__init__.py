"""massq: mass-spectrometry proteomics analytics as Spark DataFrame operators."""
