"""Name cleaning and conformance."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold_pairs() -> tuple[str, str]:
    accented, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base.isalpha():
            accented.append(chr(code))
            plain.append(base)
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _fold_pairs()

# Latin letters without a decomposition, and what they are written as in ASCII.
LETTERS = {
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T", "ð": "d", "Ð": "D", "ŋ": "n", "Ŋ": "N",
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ĳ": "ij", "Ĳ": "IJ", "ŉ": "n", "ſ": "s",
}

# Letters whose UTF-8 bytes, shown as Windows-1252, are repaired: all of two bytes up to U+017F.
REPAIRED_LETTERS = "".join(c for c in map(chr, range(0xA1, 0x180)) if c.isalpha())


def fold_accents(c: Column) -> Column:
    """Replace each accented or special Latin letter by its ASCII letters, and drop loose accents."""
    single = {a: b for a, b in LETTERS.items() if len(b) == 1}
    folded = F.translate(c, ACCENTED + "".join(single), PLAIN + "".join(single.values()))
    long = {a: b for a, b in LETTERS.items() if len(b) > 1}
    for letter, plain in long.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return F.regexp_replace(folded, r"[\u0300-\u036F]+", "")


def _misread(letter: str) -> str:
    """The letter's UTF-8 bytes as Windows-1252 shows them; bytes it does not define stay control characters."""
    shown = (bytes([b]).decode("cp1252", "replace") for b in letter.encode("utf-8"))
    return "".join(chr(b) if c == "\ufffd" else c for c, b in zip(shown, letter.encode("utf-8")))


def repair_mojibake(c: Column) -> Column:
    """Undo UTF-8 text that was read as Windows-1252, letter by letter; other text is left alone."""
    pairs = F.array(*[F.struct(F.lit(_misread(x)).alias("shown"), F.lit(x).alias("meant")) for x in REPAIRED_LETTERS])
    repaired = F.aggregate(pairs, c, lambda text, pair: F.replace(text, pair["shown"], pair["meant"]))
    return F.when(c.rlike("[ÂÃÄÅ]"), repaired).otherwise(c)


def squish(c: Column) -> Column:
    """Trim, and reduce each run of blanks, no-break spaces among them, to one space."""
    return F.trim(F.regexp_replace(c, r"[\s\u00A0]+", " "))


def sentence_case(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2_000_000_000)))


def title_case(c: Column) -> Column:
    return F.initcap(c)


def slug(c: Column) -> Column:
    """Lower-case name in which everything but letters and digits is a single dot."""
    dotted = F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", ".")
    return F.regexp_replace(dotted, r"^\.|\.$", "")


def slug_text(name: str) -> str:
    """``slug`` for one name on the driver, used on column headers."""
    plain = unicodedata.normalize("NFD", name).encode("ascii", "ignore").decode()
    return re.sub("[^a-z0-9]+", "_", plain.lower()).strip("_")


def clean_headers(df: DataFrame) -> DataFrame:
    """Give every column a clean name; names that collide get a running number."""
    seen: dict[str, int] = {}
    names = []
    for column in df.columns:
        name = slug_text(column) or "x"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def extract_label(c: Column, labels: list[str]) -> Column:
    """First of ``labels`` that occurs in the text, lower-cased; NULL when none does."""
    found = F.regexp_extract(c, "(" + "|".join(map(re.escape, labels)) + ")", 1)
    return F.when(found != "", F.lower(found))


def strip_code_prefix(c: Column) -> Column:
    """Drop a leading numeric code: ``09 Ciudad`` becomes ``Ciudad``."""
    return F.regexp_replace(c, r"^\s*[0-9]+\s+", "")


def conform(df: DataFrame, name: str, aliases: DataFrame, into: str = "entity") -> DataFrame:
    """Map free names to entities by exact match of their slugs.

    ``aliases`` has ``alias_slug`` (unique) and ``entity``. A name with no alias keeps its own slug.
    No broadcast hint: Spark broadcasts the dimension when its size allows it.
    """
    keyed = df.withColumn("_slug", slug(repair_mojibake(F.col(name))))
    looked_up = aliases.select(F.col("alias_slug").alias("_slug"), F.col("entity").alias("_entity"))
    return (
        keyed.join(looked_up, "_slug", "left")
        .withColumn(into, F.coalesce("_entity", "_slug"))
        .drop("_slug", "_entity")
    )
