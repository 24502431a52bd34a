"""riskframe.sources."""
