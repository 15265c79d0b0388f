"""Spark-native extraction and validation of invoice text.

Everything here is a ``Column -> Column`` function or a ``DataFrame ->
DataFrame`` operator; nothing runs until the caller starts an action.
"""

__version__ = "0.1.0"
