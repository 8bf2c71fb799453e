"""clipgrain: speech-feature analytics and corpus preparation as Spark jobs."""
