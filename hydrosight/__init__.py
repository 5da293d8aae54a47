"""hydrosight: PySpark-native screening of service points for summer irrigation.

Bills, contacts and meter interval reads go in; a customer-level summary, a
26-week panel and data-quality counters come out. Every transform is a lazy
``DataFrame -> DataFrame`` function built from ``pyspark.sql.functions`` so
Catalyst plans it and Tungsten runs it; see ``hydrosight.plans.job.build``.
"""

from hydrosight.params import Params

__all__ = ["Params"]
