"""Analytics over batches of trajectories in embedding space."""
