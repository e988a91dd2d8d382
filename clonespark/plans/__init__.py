"""Planning on the driver: which columns and components a query needs, and how a join is dealt out."""
