"""linecraft: Spark-native preparation and scoring of text-line recognition data.

Every operator takes and returns DataFrames; randomness is a pure function of a seed
and a row key (``linecraft.functions.rng``), so results do not depend on partitioning,
task retries or adaptive re-planning.
"""

__version__ = "0.1.0"
