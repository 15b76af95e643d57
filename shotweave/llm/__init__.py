"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries``
registers the thin ``opN_*`` queries and their DuckDB SQL. Nothing outside this
package imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: these need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
