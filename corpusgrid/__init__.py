"""corpusgrid: a Spark-first analytics engine for collections of linked documents."""

__version__ = "0.1.0"
