"""Training-data operators. Nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

import ruleframe

# Functions that run on executors travel with the job, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(ruleframe)
