"""Operators for preparing training data: language, secrets, fingerprints, media, mixing, tokens, URLs, near copies, licences, quality.

Each module has one operator with a general interface; `queries.py` applies them to the given tables.
Functions of this package travel to the workers by value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
