"""jobsmith: posting analytics as Spark jobs.

Every operator takes and returns a Spark DataFrame. Order-dependent rules use an
explicit ``ordinal`` column; nothing on a data path is collected to the driver.
"""

__version__ = "0.1.0"
