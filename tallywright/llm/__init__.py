"""Training-data operators.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
Functions that run in Python workers travel by value, and so do the models
that they read (``common.Shared``): executors need neither this package nor
the driver's folders.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
