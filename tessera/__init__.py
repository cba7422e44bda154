"""tessera: archive analytics as Spark DataFrame operators."""
