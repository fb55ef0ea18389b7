"""Secret scan with a random forest for false-positive removal, by DataFrame
functions and Spark ML alone.

A candidate is a run of at least ``LEAST`` characters of key material, less
any ``name=`` before it, or whatever a credential's word and = or : lead to,
however short and of whatever marks.  Its
features are its length, character transitions and classes, the share of its
4-letter pieces that the corpus's most frequent words hold (dictionary
coverage), the words beside it and in it, hashed, and the path (source) of its
document.  A random forest trained on labelled findings learns which of these
words tell secrets from long words, checksums and placeholders.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialise, with_row_key

LEAST = 20
# Key material, but not from the start of a name that = ties to more of it.
CANDIDATE = rf"(?=[A-Za-z0-9_/+=.-]{{{LEAST}}})(?![A-Za-z0-9_/.-]{{0,200}}+=++[A-Za-z0-9_/+.-])[A-Za-z0-9_/+=.-]{{{LEAST},}}"
#: Characters of context to the left and to the right.
LEFT, RIGHT = 60, 20
#: Words of the dictionary: the most frequent ones of 4 to 12 letters.
DICTIONARY = 5000
#: Documents that the default labelled findings are planted in or mined from.
LABELLED = 3000
#: Labelled findings that don't depend on the documents, so that any table has a model.
FIXED = 6000
#: Buckets of the hashed words.
HASHED = 512
TREES, DEPTH = 60, 12
THRESHOLD = 0.5
MASK = "[SECRET]"
# Texts that the fixed findings are planted in.
CARRIERS = [
    "please note the setting below before the next release of the service", "the values of this file were written by the build and are read at start", "bitte vor dem Start die Werte in dieser Datei setzen und speichern",
    "los valores de este archivo se leen al inicio del servicio", "les valeurs de ce fichier sont lues au moment du lancement",
]
# Words that labelled findings have before credentials, and before harmless identifiers.
SECRET_WORDS = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "auth", "credential", "private_key", "bearer"]
HARMLESS_WORDS = ["commit", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "etag", "revision", "build", "integrity", "hash"]
#: What may stand between a credential's word and its value, without the opening quote.
SIGN = r"[A-Za-z0-9_-]{0,20}[\"']?[ \t]{0,8}[=:]{1,2}>?[ \t]{0,8}"
_NAMED = "(?i:" + "|".join(SECRET_WORDS) + ")" + SIGN
# Cheap looks first: only after = or :, blanks and a quote is the word looked for.
ASSIGNED = (
    r"(?:(?<=[=:])|(?<=[ \t\"'>])(?<=[=:]>?[ \t]{0,8}[\"']?))"
    rf"(?:(?<=\")(?<={_NAMED}\")[^\s\"]+|(?<=')(?<={_NAMED}')[^\s']+|(?<={_NAMED})(?![=:>])[^\s\"']*[^\s\"',;.)\]}}])"
)
#: What candidates are found by.
PATTERN = f"{ASSIGNED}|{CANDIDATE}"
PLACEHOLDER_WORDS = ["example", "your", "changeme", "placeholder", "dummy", "sample", "xxxx", "redacted"]
FEATURES = [
    "length", "transitions", "digits", "uppers", "marks", "distinct", "hexes", "coverage", "assigned", "quoted", "path_test", "path_config",
]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per candidate: id, row (``row_col``, else a number), k (its number in the text), start, value, left, right, path.

    start is the 0-based place of its first character.  The text is cut by the
    candidate pattern, which gives what stands between candidates; null and
    candidate-free texts give no row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row")).filter(F.col("t").rlike(PATTERN))
    cut = rows.select("id", "row", "path", F.regexp_extract_all("t", F.lit(PATTERN), F.lit(0)).alias("found"), F.split("t", PATTERN, -1).alias("gaps"))
    # each gap as its length and the ends that are context; starts by a running sum over small structs
    ends = cut.select(
        "id", "row", "path", "found",
        F.transform("gaps", lambda g: F.struct(F.char_length(g).alias("n"), F.right(g, F.lit(LEFT)).alias("left"), F.left(g, F.lit(RIGHT)).alias("right"))).alias("gaps"),
    )
    one = ends.select("id", "row", "path", "gaps", F.posexplode_outer("found").alias("k", "value"))
    one = one.select("id", "row", "path", "k", "value", F.col("gaps")[F.col("k")].alias("g"), F.col("gaps")[F.col("k") + 1]["right"].alias("right"))
    before = F.sum(F.col("g.n") + F.char_length("value")).over(Window.partitionBy("row").orderBy("k"))
    return one.select("id", "row", "k", (before - F.char_length("value")).cast("long").alias("start"), "value", F.col("g.left").alias("left"), "right", "path")


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> DataFrame:
    """4-letter pieces (column piece) of the ``size`` most frequent words of 4
    to 12 letters, counted over all rows; at most 9 pieces a word."""
    words = docs.select(F.explode_outer(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"[\s.,;:!?\"'()]+")).alias("w"))
    words = words.filter((F.char_length("w") >= 4) & (F.char_length("w") <= 12) & F.col("w").rlike(r"^\p{L}+$"))
    words = materialise(words.groupBy("w").agg(F.count("*").alias("n")), "words")
    # a histogram of the counts tells which words can be among the first ones; only these are sorted
    level = F.floor(F.log2("n") * 8).cast("int")
    seen, least = 0, 0
    for r in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred rows at most
        seen, least = seen + r["count"], r["level"]
        if seen >= size:
            break
    top = words.filter(level >= least).orderBy(F.desc("n"), "w").limit(size)
    return top.select(F.explode(_pieces(F.col("w"))).alias("piece")).distinct()


def _pieces(value):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(value) - 3)), lambda i: F.substring(value, i, F.lit(4))))


def _words() -> Column:
    """The two words left of a candidate, the one right of it and those in it,
    each marked by its place."""
    find = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{2,}"), F.lit(0))
    mark = lambda words, place: F.transform(words, lambda w: F.concat(F.lit(place), w))
    left = F.reverse(find("left"))
    near = lambda k: mark(F.slice(left, k, 1), f"left{k}=")
    return F.concat(near(1), near(2), mark(F.slice(find("right"), 1, 1), "right="), mark(find("value"), "in="))


def with_features(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """``found`` with the columns of FEATURES and words; ``pieces`` is a dictionary."""
    key = ["id", "row", "k"]
    own = found.select(*key, F.explode(_pieces(F.lower("value"))).alias("piece"))
    # pieces: at most 9 x DICTIONARY rows of 4 letters, so a broadcast has a proven bound
    hits = own.join(F.broadcast(pieces.withColumn("hit", F.lit(1))), "piece", "left")
    share = hits.groupBy("row", "k").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("coverage"))
    n = F.char_length("value")
    count = lambda pattern: F.regexp_count("value", F.lit(pattern)).cast("double")
    flag = lambda column, pattern: F.col(column).rlike(pattern).cast("double")
    change = "[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])"
    return found.join(share, ["row", "k"]).select(
        *found.columns,
        n.cast("double").alias("length"), (count(change) / n).alias("transitions"), (count("[0-9]") / n).alias("digits"), (count("[A-Z]") / n).alias("uppers"),
        (count("[^A-Za-z0-9]") / n).alias("marks"), (F.size(F.array_distinct(F.split("value", ""))) / n).cast("double").alias("distinct"), flag("value", "^[0-9a-fA-F-]+$").alias("hexes"), "coverage",
        flag("left", r"[=:]\s*[\"']?$").alias("assigned"), flag("left", "[\"']$").alias("quoted"), flag("path", r"(?i)(^|[/_.-])(tests?|examples?|fixtures?|mocks?|samples?)([/_.-]|$)").alias("path_test"),
        flag("path", r"(?i)\.(env|ya?ml|json|ini|cfg|conf|toml|properties|tf)$").alias("path_config"), _words().alias("words"),
    )


def labelled_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED) -> DataFrame:
    """Labelled findings for training: candidates (as ``candidates``) with label.

    No table of reviewed findings is given, so they are derived from the
    corpus: texts are planted, and ``candidates`` finds what is labelled, so
    that its rows have the form of any other's.  The ``most`` documents with
    the least xxhash64 of their id, and ``FIXED`` carrier texts, each give
    their first 400 characters as context; in it stands, by a hash, a
    credential after a credential's word (label 1), or, with label 0, a
    checksum or identifier after a harmless word, a placeholder after a
    credential's word, a word, number or switch after one, or a long word run
    together from the document's own words.  Credentials are digests of the id
    in hex, base64 or prefixed form, and passwords of 8 characters and more;
    no value has more than 120 characters.
    """
    # twice as many as are wanted pass the threshold, so that few are sorted
    share = min(1.0, 2 * most / max(1, docs.count()))
    low = F.xxhash64("id") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)
    few = docs.select(F.col(id_col).cast("long").alias("id"), F.substring(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 1, 400).alias("t")).filter("id is not null").filter(low).orderBy(F.xxhash64("id"), "id").limit(most)
    carriers = F.get(F.array(*map(F.lit, CARRIERS)), F.pmod("id", F.lit(len(CARRIERS))).cast("int"))
    few = few.union(docs.sparkSession.range(FIXED).select("id", carriers.alias("t")).select((-1 - F.col("id")).alias("id"), "t"))
    few = few.withColumn("t", F.regexp_replace("t", PATTERN, " "))
    h = lambda salt: F.sha2(F.concat_ws("|", F.lit(salt), F.col("id").cast("string")), 256)
    r = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(n)).cast("int")
    pick = lambda values, salt: F.array(*map(F.lit, values))[r(salt, len(values))]
    b64 = F.regexp_replace(F.base64(F.unhex(h("b"))), "=+$", "")
    credential = F.array(
        F.sha1(F.col("id").cast("string").cast("binary")), F.substring(h("h"), 1, 32), h("f"), F.substring(b64, 1, 40), F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(b64, "+/", "AB"), 1, 16))),
        F.concat(F.lit("ghp_"), F.substring(F.translate(b64, "+/", "ab"), 1, 36)), F.concat(F.lit("sk-"), F.substring(F.translate(b64, "+/", "xy"), 1, 40)),
    )[r("c", 7)]
    uuid = F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 4), F.substring(h("u"), 21, 12))
    identifier = F.array(F.sha1(F.concat(F.lit("s"), F.col("id").cast("string")).cast("binary")), F.md5(F.col("id").cast("string").cast("binary")), h("i"), uuid)[r("i", 4)]
    dull = F.concat_ws("_", pick(PLACEHOLDER_WORDS, "p1"), pick(SECRET_WORDS, "p2"), pick(["here", "value", "goes_here_1234567", "xxxxxxxxxxxxxxxx"], "p3"))
    dull = F.rpad(dull, 24, "x")
    run_on = F.substring(F.rpad(F.concat(F.regexp_replace("t", r"[^A-Za-z]+", ""), F.lit("and")), 60, "thenthewordsgoon"), 1 + r("w", 10), 20 + r("n", 16))
    word = F.coalesce(F.nullif(F.regexp_extract("t", r"\b[A-Za-z]{4,10}\b", 0), F.lit("")), F.lit("winter"))
    marked = F.substring(F.translate(F.base64(F.unhex(h("s"))), "+/aEiO=", "!@#$%&9"), F.lit(1), F.lit(8) + r("s", 12))
    password = F.array(marked, marked, F.concat(word, (r("d", 9000) + 1000).cast("string")), F.concat(F.initcap(word), pick(["!", "@", "#", "$", "%", "_"], "e"), (r("d", 9000) + 10).cast("string")))[r("y", 4)]
    plain = F.array(F.lower(word), F.lower(word), r("z", 5000).cast("string"), pick(["true", "false", "none", "null", "required", "str,", "string", "optional", "<your", "${TOKEN}"], "v"))[r("x", 4)]
    kind = r("kind", 9)
    secret = (kind < 2) | (kind == 6) | (kind == 7)
    value = F.when(kind < 2, credential).when(kind == 2, identifier).when(kind == 3, dull).when(kind < 6, F.lower(run_on)).when(secret, password).otherwise(plain)
    sign, quote = pick([" = ", "=", ": ", ":"], "g"), pick(['"', "'", ""], "q")
    named = F.concat(F.when(F.col("id") % 3 == 0, F.upper(pick(SECRET_WORDS, "k"))).otherwise(pick(SECRET_WORDS, "k")), sign, quote)
    lead = F.when(secret, named).when(kind == 2, F.concat(pick(HARMLESS_WORDS, "l"), pick([" ", ": ", "=", ':"'], "m"))).when((kind == 3) | (kind == 8), named).otherwise(F.lit(""))
    tail = F.when(secret | (kind == 3) | (kind == 8), quote).otherwise(F.lit(""))
    place = pick(["src/app.py", "config/prod.env", "deploy/values.yaml", "README.md", "tests/test_login.py", "", "", ""], "path")
    before = F.concat(F.lit(" "), F.substring("t", 1, 50), F.lit(" "), lead)
    planted = few.select(
        "id", F.monotonically_increasing_id().alias("row"), F.concat(before, F.substring(value, 1, 120), tail, F.lit(" "), F.substring("t", 60, 15)).alias("text"), place.alias("path"),
        F.char_length(before).cast("long").alias("start"), secret.cast("double").alias("label"),
    )
    planted = materialise(planted, "planted")
    return candidates(planted, "id", "text", "path", "row").join(planted.select("row", "start", "label"), ["row", "start"])


def fit(labelled: DataFrame, pieces: DataFrame, seed: int = 42) -> PipelineModel:
    """A random forest on labelled findings (candidates with label 0 and 1)."""
    rows = materialise(with_features(labelled, pieces), "labelled")
    if rows.select("label").distinct().count() < 2:
        raise ValueError("findings of both labels are needed")
    hashed = HashingTF(inputCol="words", outputCol="hashed", numFeatures=HASHED, binary=True)
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=seed)
    # a few thousand rows: one partition, in a fixed order, gives one forest
    return Pipeline(stages=[hashed, VectorAssembler(inputCols=[*FEATURES, "hashed"], outputCol="features"), forest]).fit(rows.coalesce(1).sortWithinPartitions("id", "row"))


def classify(found: DataFrame, pieces: DataFrame, model: PipelineModel, threshold: float = THRESHOLD) -> DataFrame:
    """``found`` with score (the forest's probability) and is_secret."""
    got = model.transform(with_features(found, pieces))
    score = F.round(vector_to_array("probability")[1], 6)
    return got.select(*found.columns, score.alias("score"), (score >= threshold).alias("is_secret"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", row_col: str | None = None) -> DataFrame:
    """All candidates of all rows with score and is_secret, in one written table.

    ``labelled`` are labelled findings; by default they are derived from
    ``docs``.  Null texts, and an empty table, have none.  Rows with a null or
    repeated id are scanned like any other.
    """
    pieces = materialise(dictionary(docs, text_col), "dictionary")
    model = fit(labelled_findings(docs, id_col, text_col) if labelled is None else labelled, pieces)
    found = materialise(candidates(docs, id_col, text_col, path_col, row_col), "candidates")
    return materialise(classify(found, pieces, model), "findings")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by MASK, and ``size_col`` counted anew.

    Each finding is replaced where it stands, and a value of ``LEAST``
    characters or more wherever else its text repeats it.

    All rows and columns stay.  Only documents that have a candidate meet the
    findings in a join, by a key of the row, so that rows with a null or
    repeated id are treated like any other.
    """
    columns = docs.columns
    key, row, list_, out = free_names(docs, "key", "row", "secrets", "redacted")
    docs = with_row_key(docs, key)
    spot = F.struct("start", F.char_length("value").alias("n"), "value")
    secrets = scan(docs, None, id_col, text_col, path_col, key).filter("is_secret").groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(spot)).alias(list_))
    has = F.coalesce(F.col(text_col).cast("string").rlike(PATTERN), F.lit(False))
    hit = docs.filter(has).join(secrets, F.col(key) == F.col(row), "left")
    found = F.coalesce(list_, F.array().cast(secrets.schema[list_].dataType))
    # what stands between findings: from the end of the one before to the start of the next
    starts = F.concat(F.transform(found, lambda s: s["start"].cast("int")), F.array(F.char_length(text_col)))
    ends = F.concat(F.array(F.lit(0)), F.transform(found, lambda s: s["start"].cast("int") + s["n"]))
    gaps = F.zip_with(starts, ends, lambda a, z: F.substring(F.col(text_col), z + 1, a - z))
    # longer ones first, so that no secret is cut by another that it holds
    order = F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda s: s["value"]), lambda v: F.char_length(v) >= LEAST)), lambda a, b: F.char_length(b) - F.char_length(a))
    text = F.aggregate(order, F.array_join(gaps, MASK), lambda t, s: F.replace(t, s, F.lit(MASK)))
    changed = hit.withColumn(out, text)
    if size_col and size_col in columns:
        changed = changed.withColumn(size_col, F.when(F.col(list_).isNotNull(), F.char_length(out).cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col)))
    changed = changed.withColumn(text_col, F.col(out)).select(*columns)
    return docs.filter(~has).select(*columns).union(changed)
