"""Text operators: cleaning, items and sentences, keyword scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists and markers of the filings lane.
POSITIVE = ("strong", "improved", "healthy", "accelerated", "reaccelerated", "durable", "stable", "growth", "backlog", "renewal", "firm", "constructive", "supports", "resilient", "guidance", "outlook", "higher", "expansion")
NEGATIVE = ("weakened", "slower", "soft", "softness", "decline", "cut", "cautious", "mixed", "pressure", "scrutiny", "antitrust", "constraints", "compliance", "lower", "miss", "headwind")
RISK = ("regulator", "regulators", "lawsuit", "investigation", "antitrust", "scrutiny", "compliance", "uncertain", "risk", "volatility", "litigation")
GUIDANCE = ("guidance", "outlook", "expect", "expects", "expected", "forecast", "forecasts", "anticipate", "anticipates", "anticipated", "believe", "believes", "forward-looking", "will", "trend")
BOILERPLATE = (
    "forward-looking statements",
    "private securities litigation reform act",
    "assumes no obligation to revise or update",
    "see accompanying notes",
    "this item and other sections of this quarterly report",
    "this item and other sections of this annual report",
)
NOISE = ("underwriting agreement", "officers' certificate", "officers certificate", "notes due", "floating rate notes", "aggregate principal amount", "registration statement on form s-3")
ALLOWED_ITEMS = ("2.02", "7.01", "8.01")
#: Short, swing and long multipliers by kind of section.
MULTIPLIERS = {
    "earnings": (1.2, 1.0, 0.8),
    "forward_guidance": (0.9, 1.2, 1.0),
    "risk_factors": (0.7, 0.9, 1.1),
    "liquidity": (0.8, 1.0, 1.1),
    "other": (1.0, 1.0, 1.0),
}
HORIZONS = ("short_term", "swing", "long_term")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clean(text: Column) -> Column:
    """Without table-of-contents and page marks, white space collapsed."""
    out = F.regexp_replace(text, r"(?i)table of contents", " ")
    out = F.regexp_replace(out, r"(?iU)\bpage\s+\d+\b", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def items(text: Column) -> Column:
    """Item numbers like 2.02, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+\.\d+)"), F.lit(1)))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def has_any(text: Column, words: Sequence[str]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def without_boilerplate(text: Column, boilerplate: Sequence[str] = BOILERPLATE) -> Column:
    """Sentences that hold no marker; the text itself if none is left."""
    kept = F.trim(F.array_join(F.filter(sentences(text), lambda s: ~has_any(s, boilerplate)), " "))
    return F.when(kept == "", text).otherwise(kept)


def first_words(text: Column, n: int = 25) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words the text contains, as substrings."""
    low = F.lower(text)
    out = F.lit(0)
    for w in words:
        out = out + F.contains(low, F.lit(w)).cast("int")
    return out


def scored_text(docs: DataFrame, text: str = "text", boilerplate: Sequence[str] = BOILERPLATE) -> Column:
    """What scores are made of: title and text in lower case, without boilerplate sentences."""
    title = F.coalesce(F.col("title"), F.lit("")) if "title" in docs.columns else F.lit("")
    return F.lower(without_boilerplate(F.concat(title, F.lit(" "), F.coalesce(F.col(text), F.lit(""))), boilerplate))


def keyword_scores(
    docs: DataFrame, text: str = "text", positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE, risk: Sequence[str] = RISK, boilerplate: Sequence[str] = BOILERPLATE
) -> DataFrame:
    """``docs`` with positive, negative and risk hits in title and text, and the score, confidence and risk flag from them."""
    # The text is cleaned once; the hits are counted inside one lambda over it.
    counted = F.transform(F.array(scored_text(docs, text, boilerplate)), lambda t: F.struct(*[hits(t, words).alias(f"{name}_hits") for name, words in (("positive", positive), ("negative", negative), ("risk", risk))]))
    out = docs.select("*", F.inline(counted))
    total = F.col("positive_hits") + F.col("negative_hits") + F.col("risk_hits")
    return out.withColumns(
        {
            "score": clamp((F.col("positive_hits") - F.col("negative_hits")) / 4.0, -1.0, 1.0),
            "confidence": clamp(0.35 + 0.08 * total, 0.35, 0.95),
            "risk_flag": clamp(0.10 + 0.10 * F.col("risk_hits"), 0.0, 1.0),
        }
    )


def horizon_scores(scored: DataFrame, text: str = "text", boilerplate: Sequence[str] = BOILERPLATE, earnings: str = "earnings") -> DataFrame:
    """One row for each horizon: the score times the multiplier of the section, clamped; risk sections never above -0.2.

    Items 2.02, and texts that speak of earnings outside of boilerplate, have the multipliers of earnings.
    """
    section = F.lower(F.coalesce("section_type", F.lit("")))
    kind = (
        F.when(F.startswith(section, F.lit("item_2_02")) | F.contains(scored_text(scored, text, boilerplate), F.lit(earnings)), "earnings")
        .when(section.isin("forward_guidance", "risk_factors", "liquidity"), section)
        .otherwise("other")
    )
    table = F.create_map(*[x for k, v in MULTIPLIERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    base = F.when(section == "risk_factors", F.least(F.col("score"), F.lit(-0.2))).otherwise(F.col("score"))
    buckets = F.arrays_zip(F.array(*map(F.lit, HORIZONS)).alias("horizon_bucket"), F.element_at(table, kind).alias("m"))
    out = scored.withColumn("__base", base).select("*", F.inline(buckets).alias("horizon_bucket", "m"))
    return out.withColumn("score", clamp(F.col("__base") * F.col("m"), -1.0, 1.0)).drop("__base", "m")


def json_object(text: Column, schema: str) -> Column:
    """The object between the first { and the last } of a text."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def clean_text(text: str) -> str:
    """``filings.clean_filing`` of one text, for operators that hold it in Python anyway."""
    import re
    import unicodedata

    out = unicodedata.normalize("NFKC", text).replace("\u2019", "'").replace("\u2014", "-")
    out = re.sub(r"(?i)table of contents", " ", out)
    return " ".join(re.sub(r"(?i)\bpage\s+\d+\b", " ", out).split())


_HIDDEN = ("script", "style", "head", "title", "noscript", "template")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def html_text(html: str | None) -> str:
    """Visible text of a page, pieces joined by one space; hidden nodes, scripts and namespaced tags left out."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.parts: list[str] = []
            self.open: list[tuple[str, bool]] = []

        def handle_starttag(self, tag, attrs):
            if tag in _VOID:
                return
            given = {k: v or "" for k, v in attrs}
            style = given.get("style", "").replace(" ", "").lower()
            marked = given.get("aria-hidden", "").lower() == "true" or "hidden" in given.get("class", "").lower()
            hides = tag in _HIDDEN or ":" in tag or "hidden" in given or "display:none" in style or marked
            self.open.append((tag, hides))

        def handle_endtag(self, tag):
            names = [t for t, _ in self.open]
            if tag in names:
                del self.open[len(names) - 1 - names[::-1].index(tag) :]

        def handle_data(self, data):
            if not any(h for _, h in self.open):
                self.parts.append(data)

    reader = Reader()
    reader.feed(html or "")
    reader.close()
    return " ".join(" ".join(reader.parts).split())


def pages_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): a document tree is needed, so this is one of the few operators that run Python."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"page_id": f["page_id"], "text": [html_text(x) for x in f["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")
