"""Predicates and comparisons over columns, as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTERNAL = "external::"
#: Short names of base classes that belong to a framework though they are in the repo.
FRAMEWORK_NAMES = (
    r"(?:^|\\)(?:Content|Config)Entity(?:Base|Interface|Bundle\w*)$",
    r"(?:^|\\)(?:Default)?Plugin(?:Base|Manager|Interface)$",
    r"(?:^|\\)ControllerBase$",
    r"(?:^|\\)(?:Config)?FormBase$",
    r"(?:^|\\)EntityForm$",
    r"(?:^|\\)(?:Deriver|EntityAction)Base$",
    r"(?:^|\\)Constraint(?:Validator)?$",
    r"(?:^|\\)ConfirmFormBase$",
)
OPS = ("==", "!=", ">", ">=", "<", "<=")


def overlaps(lists: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(lists, F.array(*map(F.lit, wanted))), F.lit(False))


def at_least(lists: Column, n: int) -> Column:
    return F.size(lists) >= n


def either_side(a: Column, b: Column, value) -> Column:
    return (a == F.lit(value)) | (b == F.lit(value))


def holds(text: Column, part: str) -> Column:
    """Whether the text holds the part, case ignored."""
    return F.lower(text).contains(part.lower())


def near(a: Column, b, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) < tolerance


def glob_regex(glob: str) -> str:
    """The regular expression of a path glob: `**` crosses slashes (`**/` may also be nothing), `*` and `?` don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def matches_glob(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def path_family(path: Column, root: str) -> Column:
    """The folder right below root that a path is in, null outside root."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.split(path.substr(F.lit(len(prefix) + 1), F.length(path)), "/").getItem(0))


def framework_reason(qualified_name: Column, short_name: Column, base_names: bool = True) -> Column:
    """external, base or null: why a node counts as a framework's."""
    named = F.lit(False)
    for pattern in FRAMEWORK_NAMES if base_names else ():
        named = named | short_name.rlike(pattern)
    return F.when(qualified_name.startswith(EXTERNAL), "external").when(named, "base")


def compare(op: Column, a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """a op b, op being one of OPS in a column; numbers within the tolerance are equal. Null for another op or a null side."""
    same = F.abs(a - b) <= tolerance
    return F.when(op == "==", same).when(op == "!=", ~same).when(op == ">", (a > b) & ~same).when(op == ">=", (a > b) | same).when(op == "<", (a < b) & ~same).when(op == "<=", (a < b) | same)


def json_number(value: Column) -> Column:
    """The number that a JSON scalar is, else null; booleans aren't numbers."""
    return F.when(value.rlike(r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?$"), value.cast("double"))


def same_value(a: Column, b: Column) -> Column:
    """Equality of JSON texts: numbers by value (5 is 5.0), all else as written (true isn't 1)."""
    x, y = json_number(a), json_number(b)
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), x == y), a.eqNullSafe(b))


def sections(card: Column, names: list[str]) -> Column:
    """A card with only some of its sections (fields of the struct)."""
    return F.struct(*[card[n].alias(n) for n in names])
