"""Writers and the consolidated error report."""
