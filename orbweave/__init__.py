"""orbweave: scenario, schedule and corpus analytics as Spark jobs."""
