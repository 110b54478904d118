"""graphloom: a Spark-first engine for knowledge-graph analytics and data preparation."""
