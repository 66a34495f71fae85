"""Root causes from event streams over typed topologies, as Spark jobs."""
