"""Analytics over corpora of text pairs, expressed as Spark plans."""
