"""The plans of seqloom."""
