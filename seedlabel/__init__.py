"""seedlabel: weakly supervised text labelling and its evaluation on Spark.

Every public operator is DataFrame-in / DataFrame-out.  Small inputs that
steer an operator (class lists, seeds, thresholds) are passed as Python
lists/dicts or tiny DataFrames; everything that grows with the corpus stays
a distributed DataFrame.
"""

from seedlabel.session import get_spark, checkpoint_dir, load_table

__all__ = ["get_spark", "checkpoint_dir", "load_table"]
