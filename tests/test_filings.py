"""Filing sections against plain patterns that look ahead over the text."""

import random
import re

import pytest
from pyspark.sql import functions as F
from quantloom.operators import filings, text

HEADING = "Management's Discussion and Analysis of Financial Condition and Results of Operations"
PERIODIC = r"\bItem\s+(?:1A|1B|2|3|4|5|6|7|7A|8|9|9A|9B|10|11|12|13|14|15)\b"
PIECES = [
    "Item 2.02", "item 7.01.", "ITEM 8.01", "Item 9.01", "Items 2.02", "SIGNATURES", "signature", "signatures2", "Item 1A.", "Item 1A", "Item 2.", "Item 2 ", "Item 3", "Item 7.", "Item 7A", "Item 8", "Item 99",
    HEADING, HEADING.replace("'", ""), HEADING.lower(), "Liquidity and Capital Resources", "Controls and Procedures", "Quantitative and Qualitative Disclosures About Market Risk", "\n", "  ",
    "we expect more growth in the coming quarters of this year.", "Short outlook.", "These forward-looking statements are what we believe today, and no more than that.", "été É", "plain words of no use", "Critical Accounting Policies and more", "a" * 120,
]


def texts(n):
    rng = random.Random(7)
    return ["", "   ", *(" ".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(n))]


def tidy(part):
    return " ".join(part.split())


def longest(parts):
    best = ""
    for p in parts:
        if len(p) > len(best):
            best = p
    return best


def runs(body, start, end, flags=re.I):
    """From each start to the next end or signature, tidied."""
    out = []
    for m in re.finditer(start, body, flags):
        rest = body[m.end() :]
        stops = [x.start() for x in (re.search(end, rest, flags), re.search(r"\bSIGNATURES?\b", rest, flags)) if x]
        out.append(tidy(body[m.start() : m.end() + min(stops, default=len(rest))]))
    return out


def item_section(body, item):
    return longest(runs(body, rf"\bItem\s+{re.escape(item)}\.?\b", r"\bItem\s+\d+\.\d+\.?\b"))


def item_block(body, item):
    return longest(runs(body, rf"\bItem\s+{item}[.:\-\s]", PERIODIC))


def discussion(body, form):
    ends = r"\bItem\s+(?:3|4)\b" if form == "10-Q" else r"\bItem\s+(?:7A|8)\b"
    found = runs(body, HEADING.replace("'", "'?"), ends)
    return longest(found) if found else item_block(body, "2" if form == "10-Q" else "7")


def subsection(body, heading="Liquidity and Capital Resources", most=4000):
    m = re.search(re.escape(heading), body, re.I)
    if not m:
        return ""
    rest = body[m.start() :]
    stops = [re.search(r"\b[A-Z][A-Za-z/&,\-\s]{8,80}\b", rest[len(heading) + 50 :]), *(re.search(rf"\b{p}\b", rest, re.I) for p in ("Quantitative and Qualitative Disclosures About Market Risk", "Controls and Procedures"))]
    return tidy(rest[: min([most, *(s.start() for s in stops if s and s.start() > 200)])])


def guidance(body):
    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", body)]
    return " ".join([s for s in parts if len(s) >= 40 and any(k in s.lower() for k in text.GUIDANCE) and not any(b in s.lower() for b in text.BOILERPLATE)][:8])


@pytest.fixture(scope="module")
def bodies(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts(400))], "id long, t string").cache()


@pytest.mark.parametrize(
    ("plain", "column"),
    [(lambda b, i=i: item_section(b, i), lambda t, i=i: filings.item_section(t, i)) for i in ("2.02", "8.01")]
    + [(lambda b, i=i: item_block(b, i), lambda t, i=i: filings.item_block(t, i)) for i in ("1A", "2", "7")]
    + [(lambda b, f=f: discussion(b, f), lambda t, f=f: filings.discussion(t, f)) for f in ("10-Q", "10-K")]
    + [(subsection, lambda t: filings.named_subsection(t, "Liquidity and Capital Resources")), (guidance, filings.guidance_sentences)],
)
def test_against_plain_patterns(bodies, plain, column):
    for r in bodies.select("t", column(F.col("t")).alias("got")).collect():
        assert r.got == plain(r.t), r.t


def test_scoring_documents(spark):
    long = "We expect growth to continue in all of our segments during the next year. " * 5
    periodic = f"Item 2. {HEADING} {long} Liquidity and Capital Resources are fine and we will say so. {long} Item 3 x Item 1A. Risk {long} Item 6"
    rows = [
        ("a", "8-K", "2.02, 8.01, 9.01", f"Item 2.02 {long} Item 8.01 notes due {long} Item 9.01 x"),
        ("b", "8-K", "5.02", f"Item 5.02 {long}"),
        ("c", "10-Q", "", periodic),
        ("d", "S-1", "2.02", f"Item 2.02 {long}"),
        ("e", "8-K", "2.02", None),
    ]
    f = spark.createDataFrame(rows, "accession_number string, form string, items string, raw_text string").withColumns({c: F.lit("x") for c in ("ticker", "url", "company_name", "raw_title")}).withColumn("date", F.lit("2000-01-03").cast("date"))
    got = {(r.accession_number, r.section_type): r for r in filings.scoring_documents(f).collect()}
    assert set(got) == {("a", "item_2_02"), ("c", "mda"), ("c", "liquidity"), ("c", "forward_guidance"), ("c", "risk_factors")}
    assert got["a", "item_2_02"].section_id == "a::item_2_02" and got["c", "mda"].title == "10-Q MD&A" and got["c", "risk_factors"].items == "1A"


def test_scores_leave_boilerplate_out_and_read_the_title(spark):
    d = spark.createDataFrame([("Strong quarter", "Growth was healthy. These forward-looking statements mention litigation and risk.", "other")], "title string, text string, section_type string")
    r = text.keyword_scores(d).first()
    assert (r.positive_hits, r.negative_hits, r.risk_hits) == (3, 0, 0)
    only = spark.createDataFrame([("", "No earnings but in forward-looking statements on earnings.", "other")], "title string, text string, section_type string")
    assert {x.horizon_bucket: x.score for x in text.horizon_scores(text.keyword_scores(only.withColumn("score", F.lit(0.5)))).collect()}.keys() == {"short_term", "swing", "long_term"}


def test_answers(spark):
    one = '{"score": 2, "confidence": 0.5, "risk_flag": 0.5, "summary": " s "}'
    many = '{"short_term": {"score": 0.1, "confidence": 1, "risk_flag": 0}, "swing": {"score": 0.2, "confidence": 1, "risk_flag": 0}}'
    a = spark.createDataFrame([(1, f"Sure: {one}"), (2, many), (3, "none")], "id int, answer string")
    got = {(r.id, r.horizon_bucket): r for r in filings.answer_scores(a, strict=False).collect()}
    assert {k for k in got if k[0] == 1} == {(1, h) for h in text.HORIZONS} and got[1, "swing"].score == 1.0 and got[1, "swing"].adjusted_score == 0.75 and got[1, "swing"].summary == "s"
    assert {k for k in got if k[0] > 1} == {(2, "short_term"), (2, "swing")}
    assert sorted(r.id for r in filings.unreadable(a).collect()) == [2, 3]
    with pytest.raises(Exception, match="lacks a horizon"):
        filings.answer_scores(a.where("id = 2")).collect()


def test_remote_scorer(spark):
    d = spark.createDataFrame([("AAA", "T", "body")], "ticker string, title string, text string").withColumn("date", F.lit("2000-01-03").cast("date"))

    def ask(messages):
        assert [m["role"] for m in messages] == ["system", "user"] and "Ticker: AAA" in messages[1]["content"]
        return '{"score": 0.5, "confidence": 0.9, "risk_flag": 0.2}'

    rows = filings.remote_scores(d, "Score.", ask).collect()
    assert len(rows) == 3 and all(r.score == 0.5 for r in rows)


def test_companies_and_errors(spark, tmp_path):
    c = spark.createDataFrame([("aaa", 1), ("bbb", 2)], "ticker string, cik long")
    assert [r.ticker for r in filings.requested_companies(c, ["BBB", "aaa"]).collect()] == ["AAA", "BBB"]
    with pytest.raises(ValueError, match="ZZZ"):
        filings.requested_companies(c, ["zzz"])
    spark.createDataFrame([(1,)], "x int").write.option("header", True).csv(str(tmp_path / "f"))
    with pytest.raises(ValueError, match="accession_number"):
        filings.load_raw_filings(spark, str(tmp_path / "f"))


def test_python_and_column_cleaning_agree(spark):
    given = ["Table of Contents x  Page 12 y", "ﬁve ’s — é", "a b c", ""]
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", filings.clean_filing(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == [text.clean_text(r.t) for r in rows] == [text.clean_text(t) for t in given]
