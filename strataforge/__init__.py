"""Strataforge: software-repository analytics and corpus preparation as Spark plans."""
