"""Reusable plan shapes (skew-safe ranking, prefix and lag) and the two
end-to-end flows: the statistics view and the screening run."""
