"""Conversion options: a bag with defaults, and its summary as a column."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, functions as F

# Paper sizes and their numbers.
PAPER_SIZES = {"A3": 8, "A4": 9, "A5": 11, "Letter": 1, "Legal": 5, "Tabloid": 3}


@dataclass(frozen=True)
class ConvertOptions:
    password: str | None = None
    evaluate_formulas: bool = True
    one_sheet_per_page: bool = False
    landscape: bool | None = None
    paper_size: str | None = None
    sheet_names: tuple[str, ...] = ()
    exclude_hidden: bool = False
    strip_masters: bool = False
    flowing_layout: bool = True
    embed_resources: bool = True
    remove_watermarks: bool = False
    remove_watermarks_aggressive: bool = False

    def is_default(self) -> bool:
        return self == ConvertOptions()

    def summary(self) -> str:
        """What differs from the defaults; a password is named, never shown."""
        return ", ".join(text for f in fields(self) if (text := _describe(f.name, getattr(self, f.name))))


def _describe(name: str, value) -> str | None:
    if name == "password":
        return "password" if value is not None else None
    if name == "landscape":
        return None if value is None else "landscape" if value else "portrait"
    if name == "paper_size":
        return f"paper-size={value}" if value else None
    if name == "sheet_names":
        return f"sheet={','.join(value)}" if value else None
    off = {"evaluate_formulas": "no-evaluate-formulas", "flowing_layout": "fixed-layout", "embed_resources": "no-embed-resources"}
    if name in off:
        return None if value else off[name]
    return name.replace("_", "-") if value else None


def paper_size(name: str) -> str | None:
    return next((p for p in PAPER_SIZES if p.lower() == name.lower()), None)


def options_summary(o: dict[str, Column]) -> Column:
    """The summary of options given as columns; absent ones are at their defaults."""

    def flag(name: str, text: str, when: bool = True) -> Column | None:
        return F.when(o[name] == F.lit(when), F.lit(text)) if name in o else None

    parts = [
        F.when(o["password"].isNotNull(), F.lit("password")) if "password" in o else None,
        flag("evaluate_formulas", "no-evaluate-formulas", False),
        flag("one_sheet_per_page", "one-sheet-per-page"),
        F.when(o["landscape"].isNotNull(), F.when(o["landscape"], "landscape").otherwise("portrait")) if "landscape" in o else None,
        F.concat(F.lit("paper-size="), o["paper_size"]) if "paper_size" in o else None,
        F.when(F.size(o["sheet_names"]) > 0, F.concat(F.lit("sheet="), F.array_join(o["sheet_names"], ","))) if "sheet_names" in o else None,
        flag("exclude_hidden", "exclude-hidden"),
        flag("strip_masters", "strip-masters"),
        flag("flowing_layout", "fixed-layout", False),
        flag("embed_resources", "no-embed-resources", False),
        flag("remove_watermarks", "remove-watermarks"),
        flag("remove_watermarks_aggressive", "remove-watermarks-aggressive"),
    ]
    return F.concat_ws(", ", *(p for p in parts if p is not None))
