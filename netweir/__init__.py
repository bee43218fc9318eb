"""netweir: network-flow analytics as Spark DataFrame operators and streaming jobs."""
