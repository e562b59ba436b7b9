"""codequarry: repository analytics on Spark DataFrames.

Every operator is a function from DataFrames and parameters to a DataFrame.
The subpackage ``llm`` holds the operators for training data; nothing outside
of it imports it.
"""

__version__ = "0.1.0"
