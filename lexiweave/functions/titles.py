"""Title expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the prefixes of a category title.
CATEGORY_PREFIX = r"(?i)^(kategoria|category):"


def canonical_title(title: Column) -> Column:
    """The canonical form of a category title.

    Trim; drop a leading ``Kategoria:`` or ``Category:`` in any case; drop everything from the first
    ``|``; a run of blanks and underscores becomes one underscore, none at either end; the first
    letter becomes upper case. Null stays null; a blank title gives the empty string.
    """
    t = F.regexp_replace(title, r"^\s+|\s+$", "")
    t = F.regexp_replace(t, CATEGORY_PREFIX, "")
    t = F.substring_index(t, "|", 1)
    t = F.regexp_replace(t, r"[\s_]+", "_")
    t = F.btrim(t, F.lit("_"))
    # bound to a name, as the chain above would otherwise be evaluated once for each use of it
    return F.element_at(F.transform(F.array(t), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), 1)


def canonical_sql(title: str) -> str:
    """The same rule as a DuckDB expression."""
    t = rf"regexp_replace({title}, '^\s+|\s+$', '', 'g')"
    t = rf"split_part(regexp_replace({t}, '^(kategoria|category):', '', 'i'), '|', 1)"
    t = rf"regexp_replace(regexp_replace({t}, '[\s_]+', '_', 'g'), '^_|_$', '', 'g')"
    return f"(upper({t}[1:1]) || {t}[2:])"
