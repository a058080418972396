"""Paths and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names that macOS leaves in archives.
_MAC = [r"^__MACOSX", r"/__MACOSX/", r"/\._", r"^\._", r"\.DS_Store$", r"\.AppleDouble$", r"\.AppleDB$", r"\.Spotlight-V100$", r"\.Trashes$", r"\.apdisk$", r"\.fseventsd$"]
MAC_PATTERN = "|".join(_MAC)


def is_mac_metadata(path) -> Column:
    """By the full list of names, for path lists."""
    return path.rlike(MAC_PATTERN)


def is_mac_entry(name) -> Column:
    """By the three rules that apply to archive entries."""
    return name.contains("__MACOSX") | name.contains(".DS_Store") | name.startswith("._")


def clean_path(path) -> Column:
    """The last component without a leading ._ ."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"^\._", "")


def normalize_separators(path) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def keep_path(path, drop_mac: bool = True, patterns: tuple[str, ...] = ()) -> Column:
    out = ~is_mac_metadata(path) if drop_mac else F.lit(True)
    for p in patterns:
        out = out & ~path.rlike(p)
    return out


def fit_dimensions(width, height, max_width, max_height) -> Column:
    """struct(width, height) that fits the maxima at the same ratio; never larger, 1 at least, halves rounded up."""
    scale = F.least(max_width / width, max_height / height, F.lit(1.0))
    side = lambda x: F.greatest(F.lit(1), F.floor(x * scale + 0.5).cast("int"))
    fits = (width <= max_width) & (height <= max_height)
    return F.struct(F.when(fits, width).otherwise(side(width)).alias("width"), F.when(fits, height).otherwise(side(height)).alias("height"))
