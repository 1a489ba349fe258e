"""filinglake: Spark-first operators for web-page and filing corpora."""
