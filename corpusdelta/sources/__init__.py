"""Readers and writers (S1-S17): every source becomes a DataFrame through a
built-in Spark data source; nothing is read on the driver."""
