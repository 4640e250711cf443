"""The ordered cleaning plan, rule sets and master-data checks."""
