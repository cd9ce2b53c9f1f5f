"""Incremental forms of the leaderboard and of checkpointed scoring."""
