"""Running plans: job names, pre-run hooks, run records and reports."""
