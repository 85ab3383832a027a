"""biblyst: bibliographic-corpus analytics expressed as Spark DataFrame plans."""
