"""Generation scoring and training telemetry as Spark jobs."""

import sys

from pyspark import cloudpickle

from rewardloom.operators.scoring import Rewards, score
from rewardloom.profiles import SOLUTION_TAGS, V1, V2, Profile

# Functions handed to Spark's Python workers travel with their code: the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Profile", "Rewards", "SOLUTION_TAGS", "V1", "V2", "score"]
