"""Literature and knowledge-graph analytics on Spark."""
