"""lavra: Spark-first analytics over registers of property transfers, addresses, parcels and documents."""

__version__ = "0.1.0"
