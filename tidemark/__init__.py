"""Strategy analytics over candle panels and trading ledgers, written as Spark plans."""
