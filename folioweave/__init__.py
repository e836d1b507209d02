"""Set-at-a-time document intelligence and behaviour analytics on Spark."""
