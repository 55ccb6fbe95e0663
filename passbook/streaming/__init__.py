"""Arriving statements as streams: intake, completion of jobs, metrics of touched accounts."""
