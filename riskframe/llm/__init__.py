"""Training-data operators: sharding, near-duplicate search, tokenisation, packing,
language and toxicity models, web archives and vector search.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel with the tasks, so the executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
