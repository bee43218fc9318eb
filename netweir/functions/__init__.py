"""Column-level building blocks: addresses, AS numbers, names, time buckets, formats."""
