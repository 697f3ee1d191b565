"""Names as columns: normal forms, validity, fixed word sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that count as built in (compared in lower case).
BUILTINS = (
    "print len range str int float list dict set tuple bool type isinstance hasattr getattr setattr open input sum min max "
    "abs round sorted reversed enumerate zip map filter any all format repr id hash callable dir vars globals locals exec "
    "eval compile help"
).split()
# Words that are never names.
STOP_WORDS = "bir bu şu ve ile için the a an is are was were this that these function fonksiyon method metod class sınıf variable değişken yok none true false".split()
# Special methods that keep their class in a normal form.
SPECIAL_METHODS = (
    "__init__ __new__ __del__ __repr__ __str__ __call__ __enter__ __exit__ __get__ __set__ __getattr__ __setattr__ "
    "__getitem__ __setitem__ __iter__ __next__ __len__ __contains__ __add__ __sub__ __mul__ __eq__ __hash__"
).split()
#: A Unicode identifier.
IDENTIFIER = r"^[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}_]*$"


def normal(name: Column) -> Column:
    return F.lower(F.trim(name))


def base_name(name: Column) -> Column:
    """The last dotted part of a normal form."""
    return F.element_at(F.split(normal(name), r"\."), -1)


def contextual_name(name: Column) -> Column:
    """The last dotted part, but a special method keeps what stands before it."""
    return F.when(base_name(name).isin(SPECIAL_METHODS), normal(name)).otherwise(base_name(name))


def is_identifier(name: Column) -> Column:
    """Long enough, no stop word, and an identifier."""
    low = F.lower(F.trim(name))
    return F.coalesce((F.length(low) >= 2) & ~low.isin(STOP_WORDS) & low.rlike(IDENTIFIER), F.lit(False))


def is_builtin(name: Column) -> Column:
    return F.coalesce(F.lower(name).isin(BUILTINS), F.lit(False))


def same_name(a: Column, b: Column) -> Column:
    """Equal in normal form, or in base name."""
    return (normal(a) == normal(b)) | (base_name(a) == base_name(b))
