"""Point-in-time panel analytics as Spark DataFrame transformations.

Every public operator is a plain function ``DataFrame -> DataFrame`` with frozen
configuration dataclasses.  No operator reads a clock: every instant is an argument.
"""
