"""souq: marketplace catalog analytics on Spark DataFrames.

Every public function takes DataFrames (and plain parameters) and returns a
lazy DataFrame.  Nothing is collected to the driver; Catalyst and AQE pick
join strategies from real sizes.
"""

__version__ = "0.1.0"
