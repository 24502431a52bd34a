"""riskframe: Spark-native operators for labelled tabular risk data.

Profile and validate tables, detect drift, merge new keys, split
reproducibly, prepare/encode/cluster features, train and compare binary
classifiers, compute classification metrics and curves, select and gate
models, and score batches or streams - all as Spark DataFrame jobs.
"""

__version__ = "0.1.0"
