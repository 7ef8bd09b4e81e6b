"""docstruct: structure of laid-out documents as PySpark DataFrame operators."""
