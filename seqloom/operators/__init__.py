"""The operators of seqloom."""
