"""DataFrame-to-DataFrame operators. Raw rows stay in executors; only per-column summaries are small."""
