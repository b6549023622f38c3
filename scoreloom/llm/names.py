"""Dataset names and article ids in one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, control and invisible characters around an id.
_OUTER = r"(?U)^[\s\x00-\x1f\x{FEFF}\x{200B}]+|[\s\x00-\x1f\x{FEFF}\x{200B}]+$"


def dataset_key(dataset: Column) -> Column:
    """Name without case, spaces, ``_`` and ``-``; null stays null."""
    return F.regexp_replace(F.lower(dataset), r"(?U)[\s_\-]+", "")


def article_id(dataset: Column, example_id: Column) -> Column:
    """Id without outer white space, case and a leading dataset name followed by ``: / - _``.

    Null where either is null or the id is blank.
    """
    bare = F.lower(F.regexp_replace(example_id, _OUTER, ""))
    name = F.concat(F.lit("^"), F.regexp_replace(dataset_key(dataset), r"([^a-z0-9])", r"\\\\$1"))
    name = F.regexp_replace(name, r"([a-z0-9])", r"$1[\\s_-]*")
    out = F.regexp_replace(F.regexp_replace(bare, F.concat(name, F.lit(r"[:/_-]")), F.lit("")), _OUTER, "")
    return F.when(out != "", out)
