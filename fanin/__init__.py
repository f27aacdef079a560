"""fanin: bulk fusion of ranked result lists and page captures on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or a small family of
them) built from DataFrame/SQL built-ins, so Catalyst can push filters and
projections into the scans and pick join strategies at run time.
"""

__version__ = "0.1.0"
