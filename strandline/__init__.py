"""strandline: framed-signal analytics on PySpark, DataFrame in and DataFrame out."""
