"""riskframe.functions."""
