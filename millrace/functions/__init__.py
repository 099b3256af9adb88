"""Column expressions: text repair, time features, sentinels, scores."""
