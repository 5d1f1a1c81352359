"""taleweave: temporal story-graph analytics and corpus preparation on PySpark."""
