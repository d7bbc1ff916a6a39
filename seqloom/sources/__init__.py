"""Sources and sinks of seqloom."""
