"""docketry: case-text analytics expressed with the PySpark DataFrame API."""
