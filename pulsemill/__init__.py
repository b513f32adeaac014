"""pulsemill: a Spark-first trend-radar engine over streams of short posts."""
