"""Row rules, rule analysis, metrics, profiles and row operations."""
