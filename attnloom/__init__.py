"""attnloom: attention-spectrum analytics for checking language-model answers, on Spark.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
to the driver unless a docstring says so and says why it is small.
"""

__version__ = "0.1.0"
