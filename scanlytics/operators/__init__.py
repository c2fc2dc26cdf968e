"""Reusable DataFrame-to-DataFrame steps: roll-ups, rankings, sampling, filters."""
