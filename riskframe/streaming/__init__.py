"""riskframe.streaming."""
