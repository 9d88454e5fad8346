"""keelsieve: exposed-secret analytics and training-data preparation on PySpark.

Importing the package registers it for pickling by value, so that Python
functions reach executors that do not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
