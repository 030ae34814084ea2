"""Spark-native market-microstructure and pair-spread analytics."""
