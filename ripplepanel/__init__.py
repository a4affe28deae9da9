"""Spark-native measurement of policy shocks on unit x time panels."""

import sys

from pyspark import cloudpickle

from ripplepanel.policy import CITY_POLICY, Policy
from ripplepanel.session import build_session, cut, scratch_root

__all__ = ["CITY_POLICY", "Policy", "build_session", "cut", "scratch_root"]

# functions sent to Python workers travel with the job, so executors need not
# have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
