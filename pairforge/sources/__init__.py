"""Sources and sinks: catalogue scans, shard tables, embeddings, reports."""
