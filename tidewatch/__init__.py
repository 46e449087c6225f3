"""Tidewatch: Spark operators for events, intervals and group-held-out evaluation."""
