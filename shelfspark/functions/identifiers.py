"""Book identifiers: normalising, checking and classifying codes; scan-zone geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import trimmed


def normalise(code: Column) -> Column:
    """Upper case without white space and hyphens; empty for null."""
    return F.upper(F.regexp_replace(F.coalesce(code, F.lit("")), r"[\s-]", ""))


def _digit(code: Column, i: int) -> Column:
    return F.substring(code, i, 1).try_cast("int")


def is_isbn13(code: Column) -> Column:
    """Thirteen digits from 978 or 979 whose weighted sum (1, 3, 1, ...) is a multiple of ten."""
    total = sum((_digit(code, i + 1) * (1 if i % 2 == 0 else 3) for i in range(1, 13)), _digit(code, 1))
    return F.coalesce(code.rlike(r"^97[89][0-9]{10}$") & (total % 10 == 0), F.lit(False))


def is_isbn10(code: Column) -> Column:
    """Nine digits and a digit or X whose sum weighted 10 down to 1 is a multiple of eleven."""
    last = F.when(F.substring(code, 10, 1) == "X", 10).otherwise(_digit(code, 10))
    total = sum((_digit(code, i) * (11 - i) for i in range(2, 10)), _digit(code, 1) * 10) + last
    return F.coalesce(code.rlike(r"^[0-9]{9}[0-9X]$") & (total % 11 == 0), F.lit(False))


def is_asin(code: Column) -> Column:
    """Ten letters or digits that are no valid ISBN-10; a wrong check digit therefore makes an ASIN."""
    return F.coalesce(code.rlike(r"^[A-Z0-9]{10}$"), F.lit(False)) & ~is_isbn10(code)


def classify(raw: Column) -> Column:
    """ISBN, ASIN or OTHER of a scanned code."""
    code = normalise(raw)
    return F.when(is_isbn13(code) | is_isbn10(code), "ISBN").when(is_asin(code), "ASIN").otherwise("OTHER")


def returned_value(raw: Column) -> Column:
    """What a scan hands on: normalised, but trimmed only for OTHER."""
    return F.when(classify(raw) == "OTHER", trimmed(raw)).otherwise(normalise(raw))


def route(kind: Column, raw: Column, pending: Column | None = None) -> Column:
    """The form field that takes a scan result. An unknown kind is classified anew; text goes to pending, else the title."""
    known = kind.isin("ISBN", "ASIN", "OTHER", "TITLE_TEXT")
    kind = F.when(known, kind).otherwise(classify(raw))
    target = F.lit("title") if pending is None else F.coalesce(pending, F.lit("title"))
    return F.when(kind == "ISBN", "isbn").when(kind == "ASIN", "asin").when(kind == "TITLE_TEXT", target)


def in_zone(cx: Column, cy: Column, rotation: Column, image_w: Column, image_h: Column, view_w: Column, view_h: Column, zone: Column) -> Column:
    """Whether an image point lies in a zone of the view that shows the image centre-cropped.

    At 90 and 270 degrees width and height change places. zone is a struct of l, t, r, b; left and top edges belong to it.
    """
    turned = rotation.isin(90, 270)
    w, h = F.when(turned, image_h).otherwise(image_w), F.when(turned, image_w).otherwise(image_h)
    scale = F.greatest(view_w / w, view_h / h)
    x, y = cx * scale + (view_w - w * scale) / 2, cy * scale + (view_h - h * scale) / 2
    return (x >= zone["l"]) & (x < zone["r"]) & (y >= zone["t"]) & (y < zone["b"])
