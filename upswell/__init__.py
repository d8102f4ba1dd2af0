"""upswell: Spark-native analytics for what is *emerging* in a table of dated,
categorised, partly free-text records (customer complaints and the like).

Every operator is a function ``DataFrame -> DataFrame``: it builds a lazy plan
that Catalyst optimises and Spark executes. Nothing is collected to the driver
except scalars (a reference date, a bounded set of query vectors).
"""

from upswell.config import EmergenceConfig, SliceSpec

__all__ = ["EmergenceConfig", "SliceSpec"]
