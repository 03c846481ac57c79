"""Operator 7: secret scans with a random forest that removes false positives.

DataFrame and SQL functions only. Broad patterns find candidates of at least 8
characters with the word before them: runs of key-like characters with a digit,
and whatever is assigned to a credential's name, up to its closing quote or, if
unquoted, up to a blank and up to the first of , ; & < > or a quote. Candidates
may overlap; the forest judges each. Of scheme://user:password@host the password
is the candidate (one of under 8 characters: with its host), joined by ":@".
Every candidate is described by its length, its character classes and the transitions between
them, its entropy, how much of it dictionary words cover (words of letters
that occur in at least `DICTIONARY_DOCS` documents of the corpus, counted over
all of them), its path, and its neighbouring words. A random forest trained on
labelled findings scores them; its trees are turned into SQL expressions, so
scoring is part of the query.

Labelled findings are a table of (value, before, joint, label). Where none is
given they are derived from the corpus: a value that is assigned to a
credential's name, is a login's password or has a provider's key format, is
labelled 1; whole e-mail addresses, host names, numbers with separators and values made of dictionary
words are labelled 0; the rest has no label and is left to the forest. At most
`FIT_ROWS` labelled findings, taken by hash, are fitted on.

Defined results: null and empty texts have no findings; a value repeated in a
text is one finding with its number of occurrences; repeated documents repeat
their findings; with labels of one class only, all candidates get that label
as their score; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import fresh, text_or_empty
from affinity.session import materialize

FIT_ROWS = 20_000
DICTIONARY_DOCS = 3
TREES, DEPTH = 20, 6
THRESHOLD = 0.5
MASK = "[SECRET]"

_KEY = "A-Za-z0-9+/_.@=-"
# A run of key characters that holds a digit; the look-behind lets it start at a run's start only, or after the signs
# that open a run: inside one, every sign would search the rest of the run for a digit again.
CANDIDATE = rf"(?<![A-Za-z0-9+/_.@-]={{0,16}})(?=[A-Za-z+/_.@=-]*+[0-9])[A-Za-z0-9+/_.@-][{_KEY}]{{6,}}[A-Za-z0-9+/_=]"
# name = value without blanks is one run: the name is cut off where a value follows, not before the padding of base64
NAME = rf"^([A-Za-z][A-Za-z0-9_.-]{{0,40}})=(?==*[A-Za-z0-9+/_.@-][{_KEY}]{{7}})"
# The neighbouring word and what joins it to the value, at the end of the text before the value.
BEFORE = r"(://[^\s/:@]{0,64}|\S{0,40}?)([ \t]*(?:[=:][=:>]{0,2})?[ \t]*\\?[\"'`]?)$"
CONTEXT = 120
NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?-?key|access_?-?key|private_?-?key|auth|credential)s?"
CREDENTIAL = rf"(?i){NAMES}\W*$"
# What is assigned to a credential's name, of any characters: up to its closing quote, or else up to a blank. Only
# the place before the value is matched, so a value doesn't hide another one inside it.
_ASSIGNS = r"[^\w\s]{0,3}[ \t]{0,20}[=:][=:>]{0,2}"
NAMED = rf"(?i){NAMES}{_ASSIGNS}"
ASSIGNED = (rf"(?<=[=:>\s\"'`])(?<=(?i:{NAMES}){_ASSIGNS}[ \t]{{0,20}}\\?[\"'`]?)(?!(?<=[=:])[=:>])(?=("
            + "|".join(rf"(?<=\\{q})[^\n]+?(?=\\{q})|(?<={q})[^\n]+?(?=(?<!\\){q})" for q in "\"'`")
            + r"|(?!\\?[\"'`])\S+))")
# scheme://user:password@host, with the place before the password; in front of it; and the password itself
LOGIN = r"://[^\s/:@]{0,64}:[^\s/]*@"
LOGIN_VALUE = r"(?<=://[^\s/:@]{0,64}:)(?=([^\s/\"'`<>]+@[^\s\"'`<>]*))"
LOGIN_BEFORE = r"://[^\s/:@]*:[^\s/]*$"
LOGIN_PASSWORD = r"^([^/]{8,})@"
EMAIL = r"^[A-Za-z0-9._%+/=-]+@([A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"
PROVIDER = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^(ghp|gho|ghs|ghu)_[A-Za-z0-9]{30,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[A-Za-z0-9_-]{35}$|^sk_live_[A-Za-z0-9]{16,}$"
TEST_PATH = r"(?i)(^|[/_.-])(tests?|docs?|examples?|samples?|fixtures?|vendor)([/_.-]|$)"

FEATURES = ["f_length", "f_digits", "f_upper", "f_lower", "f_symbols", "f_distinct", "f_changes", "f_entropy", "f_hex",
            "f_longest", "f_dictionary", "f_credential", "f_assigned", "f_quoted", "f_path"]


def _with_context(rows: DataFrame, values: Column, taken: Column) -> DataFrame:
    """`match` (value, joint, before) of every distinct one of `values`, each of which follows one of `gaps`.

    `taken`: the text between a gap and the next. The text before a value holds the value before that, so context
    takes nothing away from the values.
    """
    none = F.array(F.lit(""))
    parts = F.arrays_zip(values.alias("value"), F.concat(none, F.col("gaps")).alias("gap_before"),
                         F.concat(none, taken).alias("taken_before"), F.col("gaps").alias("gap"))

    def packed(part: Column) -> Column:              # neither part holds a line feed
        text = F.concat(F.right(F.concat(part["gap_before"], part["taken_before"]), F.lit(CONTEXT)),
                        F.right(part["gap"], F.lit(CONTEXT)))
        return F.concat_ws("\n", part["value"], F.regexp_extract(text, BEFORE, 2), F.regexp_extract(text, BEFORE, 1))

    matches = F.transform(F.slice(parts, F.lit(1), F.size(values)), packed)
    return rows.select("doc_id", "path", "text", "text_key", F.explode(F.array_distinct(matches)).alias("match")) \
               .withColumn("match", F.split("match", "\n"))


def _at_places(rows: DataFrame, places: str) -> DataFrame:
    """The rows of `_with_context` of the values that stand at a pattern's places."""
    # a match at the very start would have no gap before it
    led = rows.withColumn("led", F.concat(F.lit("\n"), "text"))
    led = led.withColumns({"gaps": F.split("led", places, -1),
                           "values": F.regexp_extract_all("led", F.lit(places), F.lit(1))})
    return _with_context(led, F.col("values"), F.transform("values", lambda _: F.lit("")))


def _assigned(rows: DataFrame) -> DataFrame:
    """The rows of `_with_context` of values assigned to a credential's name."""
    found = _at_places(rows.where(F.col("text").rlike(NAMED)), ASSIGNED)
    value, joint, before = (F.col("match")[k] for k in range(3))
    # an unquoted value: without the punctuation after it, and up to the first character that may end it
    bare = F.regexp_replace(value, r"""[,;.)\]}>"'`\\]+$""", "")
    values = F.when(joint.rlike("[\"'`]$"), F.array(value)).otherwise(F.array_distinct(F.array(
        bare, F.regexp_extract(bare, r"""^[^,;&<>"'`]*""", 0))))
    return found.withColumn("value", F.explode(values)).withColumn("match", F.array("value", joint, before)).drop("value")


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """(doc_id, text_key, path, value, before, joint, start, occurrences): every candidate of every text."""
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    text = F.col("text")
    rows = (docs.select("doc_id", where.alias("path"), text_or_empty().alias("text"))
            .where(text.rlike(CANDIDATE) | text.rlike(NAMED) | text.rlike(LOGIN)).withColumn("text_key", F.xxhash64("text")))
    runs = rows.withColumns({"gaps": F.split("text", CANDIDATE, -1),
                             "runs": F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))})
    rows = _with_context(runs, F.col("runs"), F.col("runs")).withColumn("whole", F.lit(False)).unionByName(
        _assigned(rows).unionByName(_at_places(rows.where(text.rlike(LOGIN)), LOGIN_VALUE)).withColumn("whole", F.lit(True)))
    raw = F.col("match")[0]
    # user:password@host: the password, or with its host one that is too short to be masked wherever it stands
    login = F.concat(F.col("match")[2], F.col("match")[1]).rlike(LOGIN_BEFORE) & raw.rlike("^[^/]+@")
    password = F.regexp_extract(raw, LOGIN_PASSWORD, 1)
    name = F.when(F.col("whole") | F.col("login"), "").otherwise(F.regexp_extract(raw, NAME, 1))
    value = F.when(F.col("login"), F.when(password != "", password).otherwise(raw)).when(F.col("whole"), raw).otherwise(
        F.regexp_replace(F.when(name != "", F.expr("substring(raw, length(name) + 2)")).otherwise(F.col("raw")), r"^=+", ""))
    before = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("match")[2])
    joint = F.when(F.col("name") != "", F.lit("=")).when(F.col("login"), F.concat(F.col("match")[1], F.lit("@"))) \
             .otherwise(F.col("match")[1])
    found = (rows.withColumns({"raw": raw, "login": login}).withColumn("name", name.substr(F.lit(1), F.lit(41)))
             .withColumns({"value": value, "before": before, "joint": joint}).where(F.length("value") >= 8))
    occurrences = F.floor((F.length("text") - F.length(F.replace("text", "value", F.lit("")))) / F.length("value"))
    return found.select("doc_id", "text_key", "path", "value", "before", "joint",
                        F.expr("instr(text, value)").alias("start"), occurrences.cast("int").alias("occurrences")) \
                .dropDuplicates(["doc_id", "text_key", "path", "value", "before", "joint"])


def dictionary_coverage(values: DataFrame, docs: DataFrame, least: int = DICTIONARY_DOCS) -> DataFrame:
    """(value, coverage): the share of a value's characters in runs of letters that are words of the corpus."""
    runs = values.select("value").distinct().select("value", F.explode(F.regexp_extract_all(
        F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    text = F.lower(text_or_empty())
    words = (docs.select(F.explode(F.array_distinct(F.split(text, r"[^\p{L}]+"))).alias("word"))
             .where(F.length("word") >= 3).groupBy("word").count().where(F.col("count") >= least).select("word"))
    known = runs.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("known"))
    return known.select("value", (F.col("known") / F.length("value")).alias("coverage"))


def describe(found: DataFrame, coverage: DataFrame) -> DataFrame:
    """Candidates with the forest's features."""
    v = F.col("value")
    n = F.length(v)

    def share(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / n

    chars = F.array_distinct(F.split(v, ""))
    changes = reduce(lambda a, b: a + b, [F.regexp_count(v, F.lit(p)) for p in (
        r"[a-z](?=[A-Z0-9])", r"[A-Z](?=[0-9])", r"[0-9](?=[A-Za-z])")])
    entropy = F.aggregate(chars, F.lit(0.0), lambda total, c: total + F.when(c == "", 0.0).otherwise(
        -(n - F.length(F.replace(v, c, F.lit("")))) / n * F.log2((n - F.length(F.replace(v, c, F.lit("")))) / n)))
    longest = F.array_max(F.transform(F.regexp_extract_all(v, F.lit("[A-Za-z]+"), F.lit(0)), F.length))
    flag = {"f_credential": F.col("before").rlike(CREDENTIAL) | _in_login(), "f_assigned": F.col("joint").rlike("[=:]"),
            "f_quoted": F.col("joint").rlike("[\"'`]"), "f_path": F.col("path").rlike(TEST_PATH),
            "f_hex": v.rlike("^([0-9a-f]+|[0-9A-F]+)$")}
    out = found.join(coverage, "value", "left").withColumns({
        "f_length": n.cast("double"), "f_digits": share("[0-9]"), "f_upper": share("[A-Z]"), "f_lower": share("[a-z]"),
        "f_symbols": share("[^A-Za-z0-9]"), "f_distinct": F.size(chars) / n, "f_changes": changes / n,
        "f_entropy": entropy, "f_longest": F.coalesce(longest, F.lit(0)) / n,
        "f_dictionary": F.coalesce("coverage", F.lit(0.0)), **{k: c.cast("double") for k, c in flag.items()}})
    return out.drop("coverage")


def _in_login() -> Column:
    """Whether a finding is the password of user:password@host."""
    return F.concat("before", "joint").rlike(rf"{LOGIN_BEFORE[:-1]}@$")


def derived_label() -> Column:
    """The label of a finding whose surroundings or format settle it; null for the rest."""
    v = F.col("value")
    secret = v.rlike(PROVIDER) | ((F.col("f_credential") == 1) & (F.col("f_assigned") == 1)
                                  & (F.col("f_length") >= 12) & (F.col("f_dictionary") < 0.5))
    harmless = ~_in_login() & (v.rlike(EMAIL) | v.rlike(r"^[0-9+./_=-]+$") | (F.col("f_dictionary") >= 0.5)
                               | v.rlike(r"^(www\.|[a-z0-9-]+\.)+[a-z]{2,}(/|$)"))
    return F.when(secret, 1.0).when(harmless, 0.0)


def _tree_sql(lines: list[str]) -> str:
    """A tree's printed form as one CASE expression giving its vote."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return line.split(":")[1].strip()
    feature, limit = re.match(r"If \(feature (\d+) <= ([^)]+)\)", line).groups()
    low = _tree_sql(lines)
    lines.pop(0)                                            # Else
    return f"CASE WHEN {FEATURES[int(feature)]} <= {float(limit)!r}D THEN {low} ELSE {_tree_sql(lines)} END"


def fit_forest(labelled: DataFrame, max_rows: int = FIT_ROWS) -> str:
    """A SQL expression of a finding's score: the share of trees that call it a secret."""
    rows = labelled.select("label", *FEATURES, F.xxhash64("value", "before", "joint").alias("__h")) \
                   .dropDuplicates(["__h"]).orderBy("__h").limit(max_rows)
    rows = materialize(rows, "labelled-findings")
    classes = {r.label for r in rows.select("label").distinct().collect()}     # two rows at most
    if len(classes) < 2:
        return f"{float(classes.pop()) if classes else 0.0}D"
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=3).fit(ready.select("label", "features"))
    trees = []
    for tree in model.trees:
        lines = [x for x in tree.toDebugString.split("\n")[1:] if x.strip()]
        trees.append(f"({_tree_sql(lines)})")
    return f"({' + '.join(trees)}) / {float(len(trees))}D"


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str | None = "source") -> DataFrame:
    """Every candidate of every document with its score and verdict.

    `labelled`: findings (value, before, joint, path, label), from an audit.
    """
    found = materialize(candidates(docs, path), "secret-candidates")
    known = found.select("value") if labelled is None else found.select("value").union(labelled.select("value"))
    coverage = dictionary_coverage(known, docs)
    described = materialize(describe(found, coverage), "described-findings")
    if labelled is None:
        training = described.withColumn("label", derived_label()).where(F.col("label").isNotNull())
    else:
        training = describe(labelled.where(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("double")),
                            coverage)
    score = F.expr(fit_forest(training))
    return (described.withColumn("score", score.cast("double"))
            .select("doc_id", "text_key", "path", "value", "before", "joint", "start", "occurrences", "score",
                    (F.col("score") >= THRESHOLD).alias("is_secret")))


def mask_secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The documents with every confirmed secret replaced by a mask; `n_chars` follows the text."""
    columns = docs.columns
    own_id, own_key, values = (fresh(c, columns) for c in ("__id", "__key", "__values"))
    found = scan(docs, labelled).where("is_secret").groupBy(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)) \
                .agg(F.sort_array(F.collect_set(F.struct(-F.length("value"), "value"))).alias(values))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col(own_id)) & (F.xxhash64(docs["text"]) == F.col(own_key)), "left")
    # longer values first: one may contain another
    masked = F.aggregate(values, F.col("text"), lambda text, v: F.replace(text, v["value"], F.lit(MASK)))
    out = joined.withColumn("text", F.when(F.col(values).isNotNull(), masked).otherwise(F.col("text")))
    if "n_chars" in columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(values).isNotNull(), length).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in columns])
