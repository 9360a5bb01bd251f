"""netprobe: Spark jobs for growing and studying partially observed networks."""
