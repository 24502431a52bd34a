"""riskframe.operators."""
