"""The functions of seqloom."""
