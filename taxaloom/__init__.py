"""taxaloom: a Spark-first engine that refines k-mer based classifications of sequencing reads."""

__version__ = "0.1.0"
