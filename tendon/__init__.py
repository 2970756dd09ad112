"""Spark jobs for collections of robot manipulation episodes held as tables."""
