"""The streaming of seqloom."""
