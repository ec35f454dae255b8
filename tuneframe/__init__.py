"""tuneframe: Spark-native preparation and monitoring of instruction-tuning data.

Every operator is a plain function ``DataFrame -> DataFrame`` whose work is
expressed with Catalyst expressions, shuffles and Structured Streaming.
"""

__version__ = "0.1.0"
