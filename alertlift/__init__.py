"""alertlift: storm-alert analytics at airports, expressed as Spark jobs.

One row is one alert.  ``sources`` reads and writes tables and picks columns
from a schema, ``functions`` holds column expressions, ``operators`` holds
DataFrame-to-DataFrame steps, ``plans`` chains them into whole jobs.
"""
