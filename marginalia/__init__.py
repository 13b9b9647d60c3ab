"""marginalia: comment analytics and corpus operators on Spark."""
