"""Static review pages: every card is a column expression, the page joins a bounded number of cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STYLE = "body{font:14px sans-serif}.card{display:inline-block;margin:8px;width:320px}.frame{position:relative}.frame img{width:100%}.box{position:absolute;border:2px solid #e33}.crop{height:90px;background-repeat:no-repeat}"


def escaped(c: Column) -> Column:
    """Text that is safe between and inside tags."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def _percent(v: Column) -> Column:
    return F.format_string("%.3f%%", F.bround(v * 100, 3))


def box_markup(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """A box in shares of the image as an element placed by percentages."""
    return F.concat(F.lit('<div class="box" style="left:'), _percent(cx - w / 2), F.lit(";top:"), _percent(cy - h / 2), F.lit(";width:"), _percent(w), F.lit(";height:"), _percent(h), F.lit('"></div>'))


def crop_markup(image: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """The box enlarged: the image as a background, scaled and moved so that only the box shows."""
    place = lambda c, s: F.when(s < 1, (c - s / 2) / (1 - s)).otherwise(F.lit(0.0))
    return F.concat(
        F.lit('<div class="crop" style="background-image:url('), escaped(image), F.lit(");background-size:"), _percent(1 / w), F.lit(" "), _percent(1 / h),
        F.lit(";background-position:"), _percent(place(cx, w)), F.lit(" "), _percent(place(cy, h)), F.lit('"></div>'),
    )


def cards(items: DataFrame, boxes: DataFrame, blank_verdict: bool = False) -> DataFrame:
    """(image, html): a card an image, from items (image, plates, flags, notes) and boxes (image, ordinal, cx, cy, w, h).

    blank_verdict adds a line for a person's verdict.
    """
    drawn = boxes.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("ordinal", box_markup(*(F.col(c) for c in ("cx", "cy", "w", "h"))).alias("box"), crop_markup(F.col("image").cast("string"), *(F.col(c) for c in ("cx", "cy", "w", "h"))).alias("crop")))).alias("drawn"))
    part = lambda field: F.array_join(F.transform(F.coalesce("drawn", F.array().cast("array<struct<ordinal:int,box:string,crop:string>>")), lambda d: d[field]), "")
    verdict = F.lit('<p class="verdict">verdict: ____________ reviewer: ______</p>' if blank_verdict else "")
    name = escaped(F.col("image"))
    html = F.concat(
        F.lit('<div class="card"><div class="frame"><img src="'), name, F.lit('" alt="'), name, F.lit('">'), part("box"), F.lit("</div>"), part("crop"),
        F.lit("<p>"), name, F.lit("</p><p>"), escaped(F.array_join("flags", ", ")), F.lit("</p><p>"), escaped(F.col("notes")), F.lit("</p>"), verdict, F.lit("</div>"),
    )
    return items.join(drawn, "image", "left").select("image", html.alias("html"))


def page(title: str, drawn: DataFrame, most: int = 500) -> str:
    """One page of the first `most` cards by image."""
    safe = title.replace("&", "&amp;").replace("<", "&lt;")
    shown = [r.html for r in drawn.orderBy("image").limit(most).collect()]
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{safe}</title><style>{STYLE}</style></head><body><h1>{safe}</h1>\n' + "\n".join(shown) + "\n</body></html>\n"
