"""Regulatory filings: reading, cleaning, and cutting to sections that can be scored.

A section runs from a heading to the next boundary. So a text is split at every
boundary once, and a section is a piece that begins with, or holds, its heading:
no pattern has to look ahead over the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.operators.text import ALLOWED_ITEMS, BOILERPLATE, GUIDANCE, NOISE, clean, has_any, html_text, items, sentences

# Forms that are read, columns that a raw filing has, and where documents are.
FORMS = ("10-K", "10-Q", "8-K")
RAW_COLUMNS = ("date", "ticker", "form", "items", "accession_number", "url", "company_name", "raw_title", "raw_text")
COMPANIES_URL = "https://www.sec.gov/files/company_tickers.json"
SUBMISSIONS_URL = "https://data.sec.gov/submissions/CIK%s.json"
ARCHIVE_URL = "https://www.sec.gov/Archives/edgar/data/%d/%s/%s"
#: Headings of parts of periodic reports that end the part before them.
PERIODIC_ITEMS = ("1A", "1B", "2", "3", "4", "5", "6", "7", "7A", "8", "9", "9A", "9B", "10", "11", "12", "13", "14", "15")
#: The item that holds management's discussion, and the headings that end it, by form.
DISCUSSION = {"10-Q": ("2", ("3", "4")), "10-K": ("7", ("7A", "8"))}
_DISCUSSION_HEADING = r"Management'?s Discussion and Analysis of Financial Condition and Results of Operations"
_LIQUIDITY = "Liquidity and Capital Resources"

_SIGNED = r"\bSIGNATURES?\b"


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _longest(found: Column) -> Column:
    """The first of the longest texts of an array; empty without one."""
    return F.aggregate(found, F.lit(""), lambda a, s: F.when(F.char_length(s) > F.char_length(a), s).otherwise(a))


def _item_heading(numbers: Sequence[str]) -> str:
    return rf"\bItem\s+(?:{'|'.join(numbers)})\b"


def normalise_unicode(text: Column) -> Column:
    """Compatibility forms composed, curly apostrophes and long dashes plain. Only texts beyond ASCII go to Python."""

    @F.pandas_udf("string")
    def composed(given: pd.Series) -> pd.Series:
        return given.str.normalize("NFKC")

    wide = F.coalesce(composed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    return F.translate(wide, "’—", "'-")


def clean_filing(text: Column) -> Column:
    """``normalise_unicode``, then without table-of-contents and page marks, white space collapsed."""
    return clean(normalise_unicode(text))


def item_section(text: Column, item: str) -> Column:
    """The longest text from a heading ``Item n.nn`` to the next item or the signatures."""
    pieces = F.split(text, rf"(?iU)(?=\bItem\s+\d+\.\d+\b)|{_SIGNED}")
    own = F.filter(pieces, lambda p: p.rlike(rf"(?iU)^Item\s+{item.replace('.', '[.]')}\b"))
    return _longest(F.transform(own, _one_line))


def item_block(text: Column, item: str) -> Column:
    """The longest text from a heading ``Item n`` of a periodic report to the next one or the signatures."""
    pieces = F.split(text, rf"(?iU)(?={_item_heading(PERIODIC_ITEMS)})|{_SIGNED}")
    own = F.filter(pieces, lambda p: p.rlike(rf"(?iU)^Item\s+{item}[.:\-\s]"))
    return _longest(F.transform(own, _one_line))


def discussion(text: Column, form: str) -> Column:
    """Management's discussion: from its heading to the form's next item or the signatures; without one, the whole item."""
    item, ends = DISCUSSION[form]
    pieces = F.split(text, rf"(?iU)(?={_item_heading(ends)})|{_SIGNED}")
    own = F.transform(pieces, lambda p: _one_line(F.regexp_extract(p, rf"(?isU)({_DISCUSSION_HEADING}.*)", 1)))
    found = _longest(own)
    return F.when(found != "", found).otherwise(item_block(text, item))


def named_subsection(text: Column, heading: str, most: int = 4000) -> Column:
    """At most ``most`` characters from a heading on, ended by what looks like the next heading.

    An end counts only from its 201st character on; the first kind of end is
    counted from 50 characters beyond the heading.
    """
    at = F.regexp_instr(text, F.lit(rf"(?iu)\Q{heading}\E"))
    rest = F.substring(text, at, F.char_length(text))
    beyond = F.substring(rest, F.lit(len(heading) + 51), F.char_length(rest))
    ends = (
        F.regexp_instr(beyond, F.lit(r"(?U)\b[A-Z][A-Za-z/&,\-\s]{8,80}\b")),
        F.regexp_instr(rest, F.lit(r"(?iU)\bQuantitative and Qualitative Disclosures About Market Risk\b")),
        F.regexp_instr(rest, F.lit(r"(?iU)\bControls and Procedures\b")),
    )
    end = F.least(F.lit(most), *[F.when(e > 201, e - 1) for e in ends])
    return F.when(at > 0, _one_line(F.left(rest, end))).otherwise("")


def guidance_sentences(text: Column, keywords: Sequence[str] = GUIDANCE, boilerplate: Sequence[str] = BOILERPLATE, least: int = 40, most: int = 8) -> Column:
    """The first ``most`` sentences of ``least`` characters that hold a keyword and no boilerplate marker."""
    own = F.transform(sentences(text), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    found = F.filter(own, lambda s: (F.char_length(s) >= least) & has_any(s, keywords) & ~has_any(s, boilerplate))
    return F.trim(F.array_join(F.slice(found, 1, most), " "))


def _section(kind: str, item: Column, title: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("section_type"), item.alias("items"), title.alias("title"), text.alias("text"))


def current_sections(text: Column, item_list: Column, form: Column, least: int) -> Column:
    """Sections of a current report: its items that may be scored, in their order; noise ends item 8.01 only."""
    found = F.create_map(*[x for i in ALLOWED_ITEMS for x in (F.lit(i), item_section(text, i))])
    own = F.transform(
        F.filter(item_list, lambda i: i.isin(*ALLOWED_ITEMS)),
        lambda i: F.struct(
            F.concat(F.lit("item_"), F.replace(i, F.lit("."), F.lit("_"))).alias("section_type"), i.alias("items"), F.concat(form, F.lit(" Item "), i).alias("title"), F.element_at(found, i).alias("text")
        ),
    )
    return F.filter(own, lambda s: (F.char_length(s["text"]) >= least) & ~((s["items"] == "8.01") & has_any(s["text"], NOISE)))


def periodic_sections(text: Column, form: str, least: int) -> Column:
    """Sections of a periodic report: the discussion with its liquidity part and guidance, and the risk factors."""
    item = F.lit(DISCUSSION[form][0])

    def cut(m: Column) -> Column:
        half = max(120, least // 2)
        long = F.char_length(m) >= least
        parts = F.array(
            F.struct(long.alias("ok"), _section("mda", item, F.lit(f"{form} MD&A"), m).alias("s")),
            *[
                F.struct((long & (F.char_length(t) >= half)).alias("ok"), _section(kind, item, F.lit(f"{form} {title}"), t).alias("s"))
                for kind, title, t in (("liquidity", _LIQUIDITY, named_subsection(m, _LIQUIDITY)), ("forward_guidance", "Forward-Looking Guidance", guidance_sentences(m)))
            ],
        )
        return F.transform(F.filter(parts, lambda p: p["ok"]), lambda p: p["s"])

    # The discussion is found once, however many sections read it.
    from_discussion = F.flatten(F.transform(F.array(discussion(text, form)), cut))
    risk = F.transform(F.array(item_block(text, "1A")), lambda r: _section("risk_factors", F.lit("1A"), F.lit(f"{form} Risk Factors"), r))
    return F.concat(from_discussion, F.filter(risk, lambda s: F.char_length(s["text"]) >= max(150, least // 2)))


def scoring_documents(filings: DataFrame, least: int = 250) -> DataFrame:
    """One row for each section of a filing that is long enough to score.

    Current reports give their items 2.02, 7.01 and 8.01 as the items field
    names them, 10-Q and 10-K reports their discussion, liquidity, guidance and
    risk factors; other forms and filings without text give none.
    """
    text = F.coalesce("raw_text", F.lit(""))
    none = F.array().cast("array<struct<section_type:string,items:string,title:string,text:string>>")
    found = F.when(F.col("form") == "8-K", current_sections(text, items(F.coalesce("items", F.lit(""))), F.col("form"), least))
    for form in DISCUSSION:
        found = found.when(F.col("form") == form, periodic_sections(text, form, least))
    rows = filings.where(F.trim(text) != "").select("date", "ticker", "form", "company_name", "accession_number", F.col("url").alias("source_url"), "raw_title", F.explode(found.otherwise(none)).alias("s"))
    return rows.select(
        "date", "ticker", F.lit("sec_section").alias("doc_type"), F.lit("SEC").alias("source"), "s.title", "s.text", "form", "s.section_type", "s.items", "company_name", "accession_number",
        "source_url", F.col("accession_number").alias("document_id"), F.concat("accession_number", F.lit("::"), "s.section_type").alias("section_id"), "raw_title",
    )


# --- where filings come from -----------------------------------------------


def load_raw_filings(spark: SparkSession, path: str) -> DataFrame:
    """Stored filings with dates, upper-case tickers and forms, and no null texts; a missing column is an error."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if missing := sorted(set(RAW_COLUMNS) - set(rows.columns)):
        raise ValueError(f"the raw filings lack columns: {missing}")
    full = {c: F.coalesce(F.col(c), F.lit("")) for c in ("items", "raw_title", "raw_text", "url")}
    out = rows.withColumns({**full, "date": F.to_date("date"), "ticker": F.upper("ticker"), "form": F.upper("form")})
    return out if "source" in out.columns else out.withColumn("source", F.lit("SEC"))


def requested_companies(companies: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Rows of the company list for the tickers, sorted; tickers that it lacks are an error."""
    asked = sorted({t.upper() for t in tickers})
    known = companies.withColumn("ticker", F.upper("ticker")).where(F.col("ticker").isin(asked))
    if missing := sorted(set(asked) - {r.ticker for r in known.select("ticker").distinct().collect()}):
        raise ValueError(f"tickers that the company list lacks: {missing}")
    return known.orderBy("ticker")


def recent_filings(filings: DataFrame, forms: Sequence[str] = FORMS, since: str | None = None, most: int | None = None) -> DataFrame:
    """Each ticker's filings of the forms from ``since`` on, the ``most`` newest, with defaults for what is empty and the url."""
    out = filings.where(F.col("form").isin(*forms))
    if since:
        out = out.where(F.col("filing_date") >= F.to_date(F.lit(since)))
    if most is not None:
        newest = Window.partitionBy("ticker").orderBy(F.col("filing_date").desc(), F.col("accession_number").desc())
        out = out.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= most).drop("nth")
    filled = lambda c, other: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", other).otherwise(F.trim(c))
    plain = F.replace("accession_number", F.lit("-"), F.lit(""))
    out = out.withColumns(
        {
            "primary_document": filled(F.col("primary_document"), F.concat(plain, F.lit(".txt"))),
            "title": filled(F.col("title"), F.concat("form", F.lit(" filing"))),
            "items": F.trim(F.coalesce("items", F.lit(""))),
            "ticker": F.upper("ticker"),
        }
    )
    return out.withColumn("url", document_url(F.col("cik"), F.col("accession_number"), F.col("primary_document")))


def document_url(cik: Column, accession_number: Column, document: Column) -> Column:
    return F.format_string(ARCHIVE_URL, cik, F.replace(accession_number, F.lit("-"), F.lit("")), document)


def submissions_url(cik: Column) -> Column:
    return F.format_string(SUBMISSIONS_URL, F.lpad(cik.cast("string"), 10, "0"))


def download(filings: DataFrame, fetch, most_chars: int = 2_000_000) -> DataFrame:
    """``filings`` with raw_text and error: ``fetch(url)`` gives (content type, text); what fails has an error and no text.

    Each executor fetches its own rows, so no download passes the driver.
    """
    from quantloom.operators.text import clean_text

    schema = T.StructType([*filings.schema.fields, T.StructField("raw_text", T.StringType()), T.StructField("error", T.StringType())])

    def one(url: str, document: str) -> tuple[str | None, str | None]:
        try:
            kind, body = fetch(url)
            kind, name = (kind or "").lower(), (document or "").lower()
            if "pdf" in kind or name.endswith(".pdf"):
                return None, "pdf filing documents are not supported"
            page = "html" in kind or "xml" in kind or name.endswith((".htm", ".html", ".xml"))
            text = clean_text(html_text(body) if page else body)[:most_chars]
            return (text, None) if text else (None, "empty filing text")
        except Exception as e:  # a filing that cannot be read must not end the job
            return None, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(u, d) for u, d in zip(f["url"], f["primary_document"], strict=True)]
            yield f.assign(raw_text=[t for t, _ in got], error=[e for _, e in got])

    return filings.mapInPandas(run, schema)


# --- messages and answers of a remote scorer --------------------------------


def messages(docs: DataFrame, system: str) -> DataFrame:
    """``docs`` with the messages (role, content) that ask for a score: known fields a line each, then title and text."""
    given = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    optional = (("form", "Form"), ("section_type", "Section type"), ("items", "Items"), ("company_name", "Company"), ("source_url", "Source URL"))
    head = [line("Ticker", F.col("ticker")), line("Date", F.date_format("date", "yyyy-MM-dd")), line("Document type", F.coalesce(given("doc_type"), F.lit("document"))), line("Source", F.coalesce(given("source"), F.lit("unknown")))]
    more = [F.when(F.trim(given(c)) != "", line(label, given(c))) for c, label in optional]
    body = F.concat(F.concat_ws("\n", *head, *more), F.lit("\nTitle: "), F.trim(F.coalesce(given("title"), F.lit(""))), F.lit("\n\nDocument text:\n"), F.trim(F.coalesce("text", F.lit(""))), F.lit("\n"))
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return docs.withColumn("messages", F.array(one("system", F.lit(system)), one("user", body)))


_SCORE = "score:double,confidence:double,risk_flag:double,summary:string"
_ANSWER = f"struct<{_SCORE},short_term:struct<{_SCORE}>,swing:struct<{_SCORE}>,long_term:struct<{_SCORE}>>"


def answer_scores(answers: DataFrame, text: str = "answer", strict: bool = True) -> DataFrame:
    """One row for each horizon of a scorer's answer: score, confidence, risk_flag (clamped), adjusted and effective score, summary.

    The answer is JSON, perhaps inside other text: one score, which counts for
    every horizon, or one object a horizon. With ``strict`` a missing horizon
    or field is an error when the rows are read; else its row is left out and
    the answer is in the rows that ``unreadable`` marks.
    """
    from quantloom.operators.text import HORIZONS, clamp

    parsed = F.from_json(F.regexp_extract(F.col(text), r"(?s)\{.*\}", 0), _ANSWER)
    rows = answers.withColumn("__a", parsed)
    own = F.struct(*[F.col(f"__a.{c}").alias(c) for c in ("score", "confidence", "risk_flag", "summary")])
    single = reduce(lambda a, b: a & b, [F.col(f"__a.{c}").isNotNull() for c in ("score", "confidence", "risk_flag")])
    each = F.array(*[F.struct(F.lit(h).alias("horizon_bucket"), F.when(single, own).otherwise(F.col(f"__a.{h}")).alias("p")) for h in HORIZONS])
    out = rows.select(*answers.columns, F.inline(each))
    whole = F.col("p.score").isNotNull() & F.col("p.confidence").isNotNull() & F.col("p.risk_flag").isNotNull()
    score, sure, risk = (F.col(f"p.{c}") for c in ("score", "confidence", "risk_flag"))
    if strict:
        score = F.when(whole, score).otherwise(F.raise_error(F.concat(F.lit("the answer lacks a horizon: "), "horizon_bucket")).cast("double"))
    else:
        out = out.where(whole)
    out = out.withColumns({"score": clamp(score, -1.0, 1.0), "confidence": clamp(sure, 0.0, 1.0), "risk_flag": clamp(risk, 0.0, 1.0)})
    adjusted = clamp(F.col("score") * (1.0 - 0.5 * F.col("risk_flag")), -1.0, 1.0)
    out = out.withColumn("adjusted_score", adjusted).withColumn("effective_score", F.col("adjusted_score") * F.greatest("confidence", F.lit(0.05)))
    return out.withColumn("summary", F.left(F.trim(F.coalesce(F.col("p.summary"), F.lit(""))), F.lit(240))).drop("p")


def unreadable(answers: DataFrame, text: str = "answer") -> DataFrame:
    """The answers that lack a horizon, a field or the JSON itself."""
    from quantloom.operators.text import HORIZONS

    a = F.from_json(F.regexp_extract(F.col(text), r"(?s)\{.*\}", 0), _ANSWER)
    full = lambda p: F.coalesce(p["score"].isNotNull() & p["confidence"].isNotNull() & p["risk_flag"].isNotNull(), F.lit(False))
    return answers.where(~(full(a) | reduce(lambda x, y: x & y, [full(a[h]) for h in HORIZONS])))


def remote_scores(docs: DataFrame, system: str, ask, strict: bool = True) -> DataFrame:
    """Scores of a remote scorer: ``ask(messages)`` gives its answer, on the executors."""
    asked = messages(docs, system)
    schema = T.StructType([*docs.schema.fields, T.StructField("answer", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.drop(columns="messages").assign(answer=[ask([{"role": m["role"], "content": m["content"]} for m in ms]) for ms in f["messages"]])

    return answer_scores(asked.mapInPandas(run, schema), "answer", strict).drop("answer")
