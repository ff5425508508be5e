"""plumbline: checks whether study data and the statistics reported about it hold together.

Every operator takes DataFrames and returns DataFrames.  A finding is a reason to look, never a
verdict, and a check that cannot say anything reports ``abstained`` instead of passing.
"""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this package travel by value with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
