"""Rules about single files, in plain Python: no Spark, no I/O. Operators apply them to whole tables."""
