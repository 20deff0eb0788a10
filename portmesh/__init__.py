"""Message-graph analytics on Spark: graphs, event logs and state snapshots as DataFrames."""
