"""feedloom: Spark jobs over the feedback logs of coding agents."""
