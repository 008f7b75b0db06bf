"""Text functions as Column expressions: keys of documents and names, classes, noise, samples."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F

#: Suffixes of company names that a name's key leaves out.
SUFFIXES = ["inc", "incorporated", "corp", "corporation", "co", "company", "companies", "ltd", "limited", "plc", "llc", "lp", "llp", "ag", "sa", "nv", "se", "spa", "holdings", "holding", "group", "the", "cos"]

#: Exchanges that precede an explicit ticker.
EXCHANGES = r"(?:NYSE(?:\s*(?:Arca|American|MKT))?|NASDAQ|Nasdaq|NYSEARCA|NYSEMKT|AMEX|BATS|OTC(?:QX|QB)?)"
TICKER = r"([A-Z]{1,5}(?:[.\-][A-Z])?)"

#: Relation classes and their patterns; the first that matches names the class.
REL_CLASSES = [
    ("analyst", r"upgrad|downgrad|price target|\bratings?\b|\brates\b.*\b(buy|sell|hold|neutral)\b|coverage|reiterat|recommend|overweight|underweight|initiat"),
    ("monetary", r"\brates?\b|monetary|stimulus|quantitative|easing|tighten|taper|liquidity|bond[- ]buying|asset purchase|money supply"),
    ("capital_return", r"dividend|buyback|repurchas|distribut(es|ion) to shareholders"),
    ("ownership", r"invest|stake|shares (of|in|to)|sells shares|position|portfolio|holds|holding|owns|allocation|exposure|\bshort|insider|outflow|inflow|controls"),
    ("ma", r"acqui|merg|takeover|take over|buyout|\bbids?\b|tender offer|\bbuys?\b|purchas|divest|spin|sells (its |a )?(unit|business|division|stake|assets)"),
    ("partnership", r"partner|collaborat|allian|joint venture|teams? up|agreement|deal|licens|cooperat|works with|signs|integrat|co-develop|negotiat|in talks|meets with|discusses with|joins"),
    ("supply_chain", r"suppl|sells to|buys from|customer|client|serves|provid|contract|order|deliver|distribut|ships|vendor|sources|manufactur|outsourc|^sells$|uses"),
    ("competition", r"compet|rival|lags|outpac|outperform|underperform|beats|trails|challeng|vies|steals|disrupt|overtak|gains share|loses share|market share|dominat|compares|contrasts"),
    ("trade_policy", r"tariff|trade|import|export|embargo|quota|sanction"),
    ("legal_regulatory", r"regulat|\bsu(e|es|ing)\b|lawsuit|litigat|investigat|probe|approv|fine|penal|\bban|block|antitrust|charg|settl|court|rul(es|ing)|subpoena|accus|reject|clear|permit|audit|scrutin|oversee|enforc|files? (a )?(complaint|patent)|infring"),
    ("financing", r"lend|loan|financ|credit|debt|bond|underwrit|refinanc|default|bail|guarantee|issues|ipo|raises (capital|funds|money)|funds|funding|borrows|pays"),
    ("impact", r"affect|impact|driv|boost|hurt|weaken|strengthen|increas|reduc|decreas|benefit|pressur|drag|influenc|support|lift|lower|rais|cut|weigh|push|pull|fuel|threat|harm|damag|help|caus|lead|spur|dampen|depress|hit|rall|slump|fall|rise|gain|los|bolster|undermin|improv|worsen|stabiliz|threaten|signal|correlat|track|depend|relies|exposed|sensitive|volatil|demand|cool|heat|slow|accelerat|stimulat|buoy|encourag|limit|restrict|curb|protect|enabl|advanc|contribut|attract|declin|grow|disappoint|delay"),
    ("stance", r"critic|oppos|predict|forecast|warn|comment|expect|project|estimat|analy[sz]|review|backs|advocat|calls for|urg|prais|endors|respond|concern|monitor|disput|reflect|cites|says|believ|questions"),
    ("business", r"operat|expand|enter|launch|develop|target|focus|produc|build|lists on|offers|introduc|open|shuts|clos|treats|grows"),
    ("governance", r"hires|appoint|manag|advis|replac|represent|names|elect|nominat"),
]

#: The word lists and patterns of the noise reasons.
GENERIC = ["investors", "investor", "analysts", "analyst", "shareholders", "shareholder", "stockholders", "market", "markets", "stock market", "shares", "stock", "stocks", "u.s. stocks", "us stocks", "equities", "wall street", "consumers", "consumer", "customers", "customer", "clients", "employees", "workers", "traders", "buyers", "sellers", "users", "people", "investors and analysts", "bondholders", "creditors", "lenders", "borrowers", "homeowners", "savers", "retail investors", "institutional investors", "advertisers", "partners", "the company", "management", "board", "board of directors"]
SOURCE = r"(?i)(zacks|capital iq|etf channel|stock options channel|bnk invest|motley fool|benzinga|seeking alpha|marketwatch|thestreet|investorplace|tipranks|nasdaq\.com|validea|wall street journal|^bloomberg( news)?$|^reuters$|^cnbc$|^the street$)"
METRIC = r"(?i)^([^ ]+ ){0,3}(revenue|revenues|net revenue|sales growth|same-store sales|comparable sales|net sales|ebitda|ebit|eps|earnings per share|net income|operating income|fee income|profit|profits|operating profit|gross profit|margin|margins|gross margin|operating margin|dividend|dividends|dividend payout|guidance|cash flow|free cash flow|expenses|operating expenses|net loss|loss per share|stock price|share price|backlog|bookings|book value|market cap|market capitalization)$"
COMPANY = r"(?i)(\binc\b|\bcorp|\bco\.|\bltd\b|\bplc\b|\bllc\b|\bgroup\b|\bholdings\b|\betf\b|\bfund\b|\btrust\b|\(|\bbank\b|\bn\.?v\.?\b|\bs\.?a\.?\b|\bag\b|\breit\b)"
ORG_ALWAYS = r"(?i)^(appoints|names|named|elects|is led by|steps down from|resigns from|ceo of|chairs|nominates)$"
ORG_HIRES = r"(?i)^(hires|hired|employs)$"
PERSON = r"^[A-Z][a-zA-Z'.-]+( [A-Z][a-zA-Z'.-]+){1,2}$"
NOT_PERSON = r"(?i)(morgan|goldman|citi|bank|securities|capital|partners|advisors|advisers|associates|management|lazard|barclays|ubs|credit suisse|consult|group|holdings)"
COMPARE = r"(?i)^(outperforms|underperforms|outperformed|underperformed|lags|lagged|trails|trailed|beats the market|is outperformed by|outpaces)$"
MEMBER = r"(?i)^(includes|is part of|is included in|is a component of|ranks within|belongs to|is a member of|is constituent of)$"
FUND = r"(?i)(\betf\b|spdr|proshares|ishares|direxion|invesco qqq|\bindex fund\b)"
FUND_VERBS = r"(?i)^(affects|has exposure to|holds|weighs on|lifts|drags|drives)$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def timestamp(c: Column) -> Column:
    """A naive timestamp; bad ones are null. A trailing UTC is left out."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), " UTC$", ""), F.lit("yyyy-MM-dd HH:mm:ss"))


def identity(url: Column, body: Column) -> Column:
    """md5 of the url, or of the body's digest where there is none."""
    tight = F.trim(F.regexp_replace(body, r"\s+", " "))
    own = F.nullif(F.trim(url), F.lit(""))
    return F.md5(F.when(own.isNotNull(), F.concat(F.lit("u:"), own)).otherwise(F.concat(F.lit("c:"), F.md5(F.coalesce(tight, F.lit(""))))))


def near_key(body: Column) -> Column:
    """md5 of a body without case, punctuation and extra white space."""
    return F.md5(F.trim(F.regexp_replace(F.regexp_replace(F.lower(body), r"[^\w\s]", ""), r"\s+", " ")))


def domain(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^https?://(?:www\.)?([^/:]+)", 1)


def md5_number(c: Column) -> Column:
    """The first 32 bits of md5, as a number."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def sampled(key: Column, fraction: float) -> Column:
    """A sample that every larger fraction contains."""
    return md5_number(F.concat(F.lit("sample:"), key)) < int(fraction * 2**32)


def partition_of(key: Column, n: int) -> Column:
    return (md5_number(key) % n).cast("int")


def name_key(raw: Column) -> Column:
    """The grouping key of a name; ASCII names only (others keep their letters out)."""
    s = F.lower(F.coalesce(raw, F.lit("")))
    s = F.regexp_replace(s, r"\(.*?\)", " ")
    s = F.regexp_replace(s, r"['’`]s\b", "")
    s = F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("."), F.lit(""))
    s = F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " "))
    s = F.regexp_replace(s, r"^(?:the )+(?=.)", "")
    s = F.regexp_replace(s, r"^the$", "")
    return F.regexp_replace(s, r"(?<=.)(?: (?:%s))+$" % "|".join(SUFFIXES), "")


def slug(raw: Column) -> Column:
    return F.replace(F.upper(name_key(raw)), F.lit(" "), F.lit("_"))


def explicit_tickers(raw: Column) -> Column:
    """Tickers written out in a name, those in parentheses first."""
    a = F.regexp_extract_all(raw, F.lit(r"\(\s*(?:%s\s*:\s*)?%s\s*\)" % (EXCHANGES, TICKER)), F.lit(1))
    b = F.regexp_extract_all(raw, F.lit(r"\b%s\s*:\s*%s\b" % (EXCHANGES, TICKER)), F.lit(1))
    return F.transform(F.concat(a, b), lambda t: F.upper(F.replace(t, F.lit("."), F.lit("-"))))


def security_name(raw: Column) -> Column:
    """A listing's name without what follows a dash and without its share class."""
    n = F.trim(F.split_part(F.coalesce(raw, F.lit("")), F.lit(" - "), F.lit(1)))
    tail = r"(?i)\s+(Common Stock|Ordinary Shares|Common Shares|Class [A-Z]\b.*|American Depositary.*|Depositary Shares.*|Units?|Warrants?|Rights?)\s*$"
    return F.trim(F.regexp_replace(n, tail, ""))


def rel_class(relation: Column) -> Column:
    """The class of a relation's words. Apply it to distinct relations and join back."""
    t = F.lower(F.coalesce(relation, F.lit("")))
    return reduce(lambda out, rule: F.when(t.rlike(rule[1]), rule[0]).otherwise(out), reversed(REL_CLASSES), F.lit("other"))


def noise(a: Column, b: Column, relation: Column) -> Column:
    """The first reason for which a relation is noise, or null."""
    bare = lambda x: F.regexp_replace(F.lower(F.trim(x)), "^the ", "")
    metric = lambda x: F.trim(x).rlike(METRIC) & ~x.rlike(COMPANY)
    verb = F.trim(relation)
    person = F.trim(b).rlike(PERSON) & ~b.rlike(NOT_PERSON)
    reasons = [
        (bare(a) == bare(b), "self_loop"), (a.rlike(SOURCE) | b.rlike(SOURCE), "source"), (metric(a) | metric(b), "metric"),
        (bare(a).isin(GENERIC) | bare(b).isin(GENERIC), "generic"), (verb.rlike(ORG_ALWAYS), "orgchart"), (verb.rlike(ORG_HIRES) & person, "orgchart"),
        (verb.rlike(COMPARE), "comparison"), (verb.rlike(MEMBER), "membership"), (verb.rlike(FUND_VERBS) & (a.rlike(FUND) | b.rlike(FUND)), "membership"),
    ]
    return reduce(lambda out, r: F.when(r[0], r[1]).otherwise(out), reversed(reasons), F.lit(None).cast("string"))


def clamp01(c: Column) -> Column:
    """A number within [0, 1]; what is none is null."""
    x = c.try_cast("double")
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def cut_at_blank(c: Column, n: int) -> Column:
    """At most n characters, cut at the last blank if that lies in the last tenth."""
    head = F.substring(c, 1, n)
    back = F.locate(" ", F.reverse(head))
    at = F.lit(n) - back
    return F.when(F.length(c) <= n, c).when((back > 0) & (at > F.lit(0.9 * n)), F.substring(head, F.lit(1), at)).otherwise(head)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity, with a scale of 0.1 over at most 4 common first letters."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [ch for ch, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    common = 0
    while common < min(4, len(a), len(b)) and a[common] == b[common]:
        common += 1
    return jaro + common * 0.1 * (1 - jaro) if jaro >= 0.7 else jaro


def jaro_winkler_column(a: Column, b: Column) -> Column:
    """Vectorised over Arrow batches; for pairs that an equality has met before."""
    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler(p, q) for p, q in zip(x, y)], dtype="float64")

    return score(a, b)
