"""Text rules as Column expressions: cleaning, classification, headings, chunks.

They stay inside the row, so none of them shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headings of a reference section.
REFERENCE_HEADINGS = ["references", "bibliography", "works cited", "reference", "literature cited"]
# Citation and caption patterns, and what is not allowed in a cleaned text.
BRACKETS = r"\[\s*\d+(?:\s*[,;]\s*\d+)*\s*\]"
AUTHOR_YEAR = r"\([A-Za-z]+(?:\s+et\s+al)?(?:,\s*\d{4})\)"
CAPTION = r"^(figure|fig\.|table)\s*\d+"
NOT_ALLOWED = r"""[^A-Za-z0-9\s\.,;:'"\(\)\[\]\?\!\-]"""
# Blocks of a page that hold no text.
HTML_BLOCKS = ["script", "style", "header", "footer", "nav", "aside", "form", "noscript"]
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
# Meta tags that may hold a date, in order, and date phrases.
DATE_TAGS = [
    ("name", "pubdate"), ("name", "publishdate"), ("name", "publish_date"), ("name", "date"), ("name", "datePublished"), ("name", "updated"), ("name", "dateModified"), ("name", "Last-Modified"),
    ("property", "article:published_time"), ("property", "article:modified_time"), ("itemprop", "datePublished"), ("itemprop", "dateModified"),
]
DATE_PHRASES = ["Updated on", "Published on", "Last updated:", "Written on"]
# Countries by domain and by top-level domain.
COUNTRY_DOMAINS = [("nih.gov", "United States"), ("cancer.org", "United States"), ("jamanetwork.com", "United States"), ("bmj.com", "UK"), ("nature.com", "UK")]
COUNTRY_TLDS = [("us", "United States"), ("uk", "United Kingdom"), ("de", "Germany"), ("ca", "Canada"), ("au", "Australia"), ("in", "India")]
# Source types by patterns in the address, in order.
SOURCE_TYPES = [
    ("NIH/PubMed", ["nih.gov", "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov/pmc", "pmc.ncbi.nlm.nih.gov"]),
    ("Clinical Journal", ["jamanetwork.com", "ajronline.org", "ascopubs.org", "biomedcentral.com", "bmj.com", "thelancet.com", "nejm.org", "nature.com/articles", "sciencedirect.com", "mdpi.com", "jphe.amegroups.org", "ccts.amegroups.org", "e-emj.org"]),
    ("Research Database", ["journals.plos.org", "plosone.org", "frontiersin.org", "hindawi.com", "springer.com", "wiley.com", "academic.oup.com"]),
    ("Trusted Health Portal", ["cancer.org", "cancer.gov", "mayoclinic.org", "cdc.gov", "who.int", "webmd.com", "healthline.com", "medicalnewstoday.com", "nccih.nih.gov", "cancerresearchuk.org", "maxhealthcare.in"]),
    ("Medical Institution", ["clevelandclinic.org", "hopkinsmedicine.org", "mskcc.org", "mdanderson.org", "mayo.edu", "stanfordhealthcare.org"]),
    ("Government Health Agency", [".gov/health", ".gov/diseases", ".gov/about-cancer", ".gov/tb", "cdc.gov", "fda.gov", "hhs.gov"]),
]
OPEN_JOURNALS = ["plos", "biomedcentral", "mdpi", "nature", "springer"]
# What an author's name doesn't contain, and titles that it may.
NOT_NAMES = [r"^https?://", "@", r"\d{4}-\d{2}-\d{2}", r"^\d+$", "copyright", "all rights reserved", "editorial", "staff writer", "news team", r"^for\s+"]
HONORIFICS = ["dr", "prof", "mr", "mrs", "ms"]
# Words that mark a heading.
HEADING_WORDS = [
    "introduction", "overview", "background", "summary", "conclusion", "abstract", "methods", "results", "discussion", "references",
    "symptoms", "treatment", "diagnosis", "causes", "prevention", "what is", "how to", "why", "when", "where", "section",
]
# Words that answer overlap leaves out.
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "was", "are", "were", "been", "be", "have", "has", "had"]
# Class names that are spelled in several ways.
CLASS_NAMES = [
    ("adenocarcinoma", "adenocarcinoma"), ("bengin cases", "benign"), ("bengincases", "benign"), ("bengin case", "benign"), ("large.cell.carcinoma", "large_cell_carcinoma"),
    ("malignant cases", "malignant"), ("malignantcases", "malignant"), ("malignant case", "malignant"), ("normal", "normal"), ("squamous.cell.carcinoma", "squamous_cell_carcinoma"),
]


#: What a word is made of, and its borders, the same under every version of Java.
WORD = r"\p{L}\p{N}_"
BEFORE, AFTER = rf"(?<![{WORD}])", rf"(?![{WORD}])"


#: What ``\s`` matches in a pattern.
BLANKS = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Without blanks at both ends; a pattern would be tried at every blank of the text, and stop at some line ends."""
    return F.btrim(c, F.lit(BLANKS))


def strip_references(text: Column) -> Column:
    """What stands before the first reference heading at a line's start or end."""
    low = F.lower(text)
    marks = [m for h in REFERENCE_HEADINGS for m in ("\n" + h, "\r\n" + h, h + "\n")]
    first = F.least(*[F.nullif(F.instr(low, m), F.lit(0)) for m in marks])
    return strip(F.when(first.isNull(), text).otherwise(F.left(text, first - 1)))


def clean(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, BRACKETS, ""), AUTHOR_YEAR, "")
    t = F.regexp_replace(t, "(?imd)" + CAPTION, "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\n\t]+", " "), r"\s{2,}", " ")
    return strip(F.regexp_replace(t, NOT_ALLOWED, ""))


def html_text(html: Column) -> Column:
    """Text of a page, blocks without text left out, one line per tag."""
    t = html
    for tag in HTML_BLOCKS:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|<[^>]+>", "\n")
    for entity, char in HTML_ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.regexp_replace(t, r"\s*\n\s*", "\n")


def title(html: Column) -> Column:
    """The title, else the first heading, else "Untitled"."""
    part = lambda p: F.nullif(strip(F.regexp_extract(html, p, 1)), F.lit(""))
    return F.coalesce(part(r"(?is)<title[^>]*>(.*?)</title>"), part(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit("Untitled"))


def date_patterns() -> list[str]:
    tags = [rf"""(?i)<meta[^>]*\b{k}=["']{v}["'][^>]*content=["']([^"']+)["']""" for k, v in DATE_TAGS]
    return tags + [rf"(?i){p} (\d{{4}}-\d{{2}}-\d{{2}})" for p in DATE_PHRASES]


def publish_date(html: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in date_patterns()])


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z]+://([^/?#]*)", 1)


COUNTRY_META = r"""(?i)<meta[^>]*name=["']geo\.country["'][^>]*content=["']([^"']+)["']"""
COUNTRY_LOCALE = r"""(?i)<meta[^>]*property=["']og:locale["'][^>]*content=["'][^"'_]*_([^"'_]+)"""


def country(url: Column, html: Column) -> Column:
    h = host(url)
    known = F.coalesce(*[F.when(h.contains(d), F.lit(c)) for d, c in COUNTRY_DOMAINS])
    tld = F.coalesce(*[F.when(F.regexp_extract(h, r"([^.]*)$", 1) == t, F.lit(c)) for t, c in COUNTRY_TLDS])
    meta = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    return F.coalesce(known, meta(COUNTRY_META), meta(COUNTRY_LOCALE), tld, F.lit("Unknown"))


def source_type(url: Column) -> Column:
    low, h = F.lower(url), host(url)
    any_of = lambda c, ps: F.greatest(*[c.contains(p) for p in ps], F.lit(False))
    (_, nih), *others = SOURCE_TYPES
    out = F.when(any_of(low, nih), F.when(low.contains("pmc"), "PubMed Central").when(low.contains("pubmed"), "PubMed").otherwise("NIH"))
    for name, patterns in others:
        out = out.when(any_of(low, patterns), name)
    out = out.when(low.rlike("/articles?/") & any_of(h, OPEN_JOURNALS), "Open Access Journal")
    return out.otherwise("Medical Website")


def topics(text: Column, keywords: list[str]) -> Column:
    """The keywords that stand as words in the text, sorted.

    A text is searched for a keyword's borders only if it holds the keyword.
    """
    low = F.lower(text)
    return F.sort_array(F.array_compact(F.array(*[F.when(low.contains(k) & low.rlike(f"{BEFORE}{k}{AFTER}"), F.lit(k)) for k in keywords])))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def token_count(text: Column) -> Column:
    """Words and single marks: an approximation of a vocabulary's tokens."""
    return F.regexp_count(text, F.lit(rf"[{WORD}]+|[^{WORD}\s]"))


NAME_ONE = r"^[A-Z][A-Za-z]+$"
NAME_FEW = r"^[A-Z]\S*(\s+[A-Z]\S*){1,2}$"
NAME_FOUR = r"^[A-Z]\S*(\s+[A-Z]\S*){3}$"
NAME_TITLE = r"(?i)(^|\s)(" + "|".join(HONORIFICS) + r")\.?(\s|$)"


def is_name(x: Column) -> Column:
    s = strip(x)
    return (F.char_length(s) <= 100) & ~s.rlike("(?i)" + "|".join(NOT_NAMES)) & (s.rlike(NAME_ONE) | s.rlike(NAME_FEW) | (s.rlike(NAME_FOUR) & s.rlike(NAME_TITLE)))


def authors(names: Column) -> Column:
    return F.filter(names, is_name)


FRONT = r"(?s)^---(.*?)---(.*)$"


def front_matter(text: Column) -> tuple[Column, Column]:
    """(metadata map, content) of a text that may start with a --- block."""
    head = F.regexp_extract(text, FRONT, 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    clean_ = lambda v: F.regexp_replace(strip(v), "^[\"']+|[\"']+$", "")
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), clean_(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    has = text.rlike(FRONT)
    # of a repeated key the last counts
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    meta = F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])))
    return F.when(has, meta).otherwise(F.create_map().cast("map<string,string>")), F.when(has, strip(F.regexp_extract(text, FRONT, 2))).otherwise(text)


HEADER = r"^(#{1,6})\s+(.+)$"
BOLD = r"^\*\*(.+?)\*\*$|^__(.+?)__$"
ANY_WORD = "|".join(HEADING_WORDS)
ONE_WORD = r"(?i)(^|\s)(" + "|".join(w for w in HEADING_WORDS if " " not in w) + r"):*(\s|$)"


def heading_level(s: Column, words: Column, following: Column) -> Column:
    """Level of a stripped line that looks like a heading, 0 if it doesn't or is
    one already; ``words`` and ``following`` count its and the next line's words."""
    lead_in = (words < 20) & (following > words) & ~s.rlike(r"[.,;!?]$")
    return (
        F.when((s == "") | s.rlike(r"^#{1,6}\s"), 0)
        .when(s.rlike(BOLD) & (word_count(F.regexp_replace(s, r"^(\*\*|__)|(\*\*|__)$", "")) <= 10), 2)
        .when((F.upper(s) == s) & (F.lower(s) != s) & (words.between(2, 12) | ((words == 1) & s.contains("-"))), 2)
        .when(lead_in & F.lower(s).rlike(ANY_WORD), 1)
        .when(lead_in & s.rlike(r"^\d+\.?\d*\.?\s+[A-Z]"), 2)
        .when(s.rlike(r"^\d+(\.\d+)*\.\s+[A-Z]") & (F.char_length(s) < 80), 2)
        .when(s.rlike(r"\?$") & (words <= 12) & s.rlike(r"^\p{Lu}"), 3)
        .when(words.between(2, 10) & s.rlike(ONE_WORD) & (F.regexp_count(s, F.lit(r"(^|\s)\p{Lu}")) >= words * 0.6), 1)
        .otherwise(0)
    )


def with_lines(df: DataFrame, text: str, out: str = "lines") -> DataFrame:
    """``out``: array of (pos, line, s, level), one per line of the text.

    Built in steps, so that a lambda never evaluates an array again per line.
    """
    df = df.withColumn("_rows", F.split(text, "\n", -1))
    df = df.withColumn("_s", F.transform("_rows", strip))
    df = df.withColumn("_w", F.transform("_s", word_count))
    df = df.withColumn("_next", F.concat(F.slice("_w", F.lit(2), F.size("_w")), F.array(F.lit(0))))
    df = df.withColumn("_zip", F.arrays_zip("_rows", "_s", "_w", "_next"))
    one = lambda r, i: F.struct(i.alias("pos"), r["_rows"].alias("line"), r["_s"].alias("s"), heading_level(r["_s"], r["_w"], r["_next"]).alias("level"))
    return df.withColumn(out, F.transform("_zip", one)).drop("_rows", "_s", "_w", "_next", "_zip")


def with_marked(df: DataFrame, text: str, out: str) -> DataFrame:
    """``out``: the text with detected headings as # lines; texts with # lines stay."""
    def mark(r):
        bare = F.regexp_replace(r["s"], r"^\*\*(.+?)\*\*$|^__(.+?)__$", "$1$2")
        return F.when(r["level"] > 0, F.concat(F.repeat(F.lit("#"), r["level"]), F.lit(" "), bare)).otherwise(r["line"])
    df = with_lines(df, text, "_lines")
    return df.withColumn(out, F.when(F.col(text).rlike(r"(?m)^\s*#{1,6}\s+\S"), F.col(text)).otherwise(F.array_join(F.transform("_lines", mark), "\n"))).drop("_lines")


def with_chunks(df: DataFrame, text: str, out: str = "chunks") -> DataFrame:
    """``out``: array of (header, level, content): a chunk starts at each header
    of the text's highest level; text before it is "Introduction"; empty ones
    go.  A text whose highest level is 6 counts as level 1, so it isn't cut."""
    df = df.withColumn("_rows", F.split(text, "\n", -1))
    df = df.withColumn("_heads", F.transform("_rows", lambda x: F.char_length(F.regexp_extract(strip(x), HEADER, 1))))
    df = df.withColumn("_top", F.array_min(F.filter("_heads", lambda n: n > 0)))
    df = df.withColumn("_top", F.when(F.coalesce("_top", F.lit(6)) == 6, 1).otherwise(F.col("_top")))
    df = df.withColumn("_zip", F.arrays_zip(F.col("_heads").alias("n"), F.array_repeat("_top", F.size("_heads")).alias("top")))
    df = df.withColumn("_starts", F.filter(F.transform("_zip", lambda x, i: F.when((x["n"] > 0) & (x["n"] <= x["top"]), i)), lambda i: i.isNotNull()))
    df = df.withColumn("_edges", F.arrays_zip(F.concat(F.array(F.lit(-1)), "_starts").alias("s"), F.concat("_starts", F.array(F.size("_rows"))).alias("e")))
    def cut(x):
        s, e = x["s"], x["e"]
        own = F.get("_rows", s)
        return F.struct(
            F.when(s < 0, "Introduction").otherwise(F.regexp_extract(strip(own), HEADER, 2)).alias("header"), F.when(s < 0, 0).otherwise(F.get("_heads", s)).alias("level"),
            strip(F.array_join(F.slice("_rows", s + 2, F.greatest(F.lit(0), e - s - 1)), "\n")).alias("content"),
        )
    return df.withColumn(out, F.filter(F.transform("_edges", cut), lambda c: c["content"] != "")).drop("_rows", "_heads", "_top", "_zip", "_starts", "_edges")


def embed_text(heading: Column, content: Column) -> Column:
    """Title twice, then content; one alone if the other is empty."""
    t, c = strip(F.coalesce(heading, F.lit(""))), strip(F.coalesce(content, F.lit("")))
    return F.when((t != "") & (c != ""), F.concat(t, F.lit(". "), t, F.lit(". "), c)).when(t != "", t).otherwise(c)


def class_name(c: Column) -> Column:
    n = F.lower(F.trim(c))
    n = F.when(n.contains("_") & n.contains("carcinoma"), F.substring_index(n, "_", 1)).otherwise(n)
    known = F.coalesce(*[F.when(n == a, F.lit(b)) for a, b in CLASS_NAMES])
    return F.coalesce(known, F.regexp_replace(n, "[ .]", "_"))


def bins(value: Column, ranges: list[tuple[str, float, float]]) -> Column:
    """Name of the first closed range that holds the value, else "Unknown"."""
    return F.coalesce(*[F.when(value.between(lo, hi), F.lit(name)) for name, lo, hi in ranges], F.lit("Unknown"))


def first_rule(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Name of the first rule one of whose terms the text contains."""
    out = [F.when(F.greatest(*[text.contains(t) for t in terms], F.lit(False)), F.lit(name)) for name, terms in rules]
    return F.coalesce(*out, F.lit(default))


# Slices of queries and of their contexts.
QUERY_DOMAINS = [("tuberculosis", ["tb", "tuberculosis"]), ("lung_cancer", ["lung cancer", "nsclc"])]
QUERY_TYPES = [("symptom", ["symptom", "sign"]), ("diagnosis", ["diagnos", "test"]), ("treatment", ["treat", "therap"])]
COMPLEX_TERMS = ["mechanism", "pathophysiology", "differential"]
SPECIALTIES = [("respiratory", ["tb", "tuberculosis", "mycobacterium"]), ("oncology_lung", ["lung cancer", "nsclc", "sclc"]), ("oncology_general", ["cancer", "chemotherapy", "radiation"])]


def overlap_words(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(text), rf"[^{WORD}\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.char_length(w) > 2) & ~w.isin(STOP_WORDS))


def with_overlap(df: DataFrame, answer: str, truth: str) -> DataFrame:
    """Adds set precision, recall, F1, unigram and bigram Jaccard of two texts.

    All are 0 if either text has no words; bigram_overlap is if either has no
    pair of words.
    """
    pairs = lambda w: F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.greatest(F.lit(0), F.size(w) - 1)), F.slice(w, F.lit(2), F.size(w)), lambda x, y: F.concat(x, F.lit(" "), y)))
    df = df.withColumn("_a", overlap_words(F.col(answer))).withColumn("_b", overlap_words(F.col(truth)))
    df = df.withColumn("_pa", pairs("_a")).withColumn("_pb", pairs("_b")).withColumn("_sa", F.array_distinct("_a")).withColumn("_sb", F.array_distinct("_b"))
    df = df.withColumn("_k", F.size(F.array_intersect("_sa", "_sb")).cast("double")).withColumn("_kp", F.size(F.array_intersect("_pa", "_pb")).cast("double"))
    na, nb, pa, pb = (F.size(c) for c in ("_sa", "_sb", "_pa", "_pb"))
    full = lambda c, ok: F.round(F.when(ok, c).otherwise(F.lit(0.0)), 6)
    both, paired = (na > 0) & (nb > 0), (pa > 0) & (pb > 0)
    return df.withColumns({
        "keyword_precision": full(F.try_divide("_k", na), both), "keyword_recall": full(F.try_divide("_k", nb), both), "keyword_f1": full(F.try_divide(2 * F.col("_k"), na + nb), both),
        "unigram_overlap": full(F.try_divide("_k", na + nb - F.col("_k")), both), "bigram_overlap": full(F.try_divide("_kp", pa + pb - F.col("_kp")), both & paired),
    }).drop("_a", "_b", "_pa", "_pb", "_sa", "_sb", "_k", "_kp")


OVERLAP = ["keyword_precision", "keyword_recall", "keyword_f1", "unigram_overlap", "bigram_overlap"]
