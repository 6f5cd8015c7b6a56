"""Sedimenta: corpus, graph and search operators as Spark DataFrame plans."""
