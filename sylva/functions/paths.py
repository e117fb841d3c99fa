"""Paths of a tree: components, walk order, names, estimates and times, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE, DIRECTORY, SYMLINK = "file", "directory", "symlink"
#: Estimated bytes of a row's JSON apart from its name and target.
ESTIMATES = {FILE: 140, DIRECTORY: 45, SYMLINK: 46}
NANOS = 1_000_000_000


def components(path: Column) -> Column:
    """The names along a path. Ordering by them is the walk order: bytewise by name, a directory before
    its contents, and these before its next sibling."""
    return F.split(path, "/")


def joined(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat_ws("/", parent, name))


def parent_of(comps: Column) -> Column:
    """The path of the directory that holds an entry; empty at the root."""
    return F.array_join(F.slice(comps, F.lit(1), F.greatest(F.size(comps) - 1, F.lit(0))), "/")


def prefixes(comps: Column, own: bool) -> Column:
    """The paths of all directories above, outermost first, and with ``own`` the path itself."""
    last = F.size(comps) - (0 if own else 1)
    upto = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(upto, lambda n: F.array_join(F.slice(comps, F.lit(1), n), "/"))


def estimate(kind: Column, name: Column, target: Column) -> Column:
    """Estimated bytes of an entry's JSON: by kind, and the UTF-8 bytes of its name and target."""
    base = F.when(kind == FILE, ESTIMATES[FILE]).when(kind == DIRECTORY, ESTIMATES[DIRECTORY]).otherwise(ESTIMATES[SYMLINK])
    return (base + F.octet_length(name) + F.octet_length(F.coalesce(target, F.lit("")))).cast("long")


def nanos_of(ns: Column) -> Column:
    """The nanoseconds after the whole second before: counted forward, before 1970 too."""
    return F.pmod(ns, F.lit(NANOS)).cast("int")


def seconds_of(ns: Column) -> Column:
    """Whole seconds of a count of nanoseconds, rounded down, in whole numbers."""
    return ((ns - F.pmod(ns, F.lit(NANOS))).cast("decimal(38,0)") / F.lit(NANOS).cast("decimal(38,0)")).cast("long")
