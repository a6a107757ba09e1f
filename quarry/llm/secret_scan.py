"""Secret scans: candidates by form, false positives removed by a random forest.

Candidates are all runs of 12 or more value characters with a letter, wherever they stand in a word (JSON, URLs, lists), and
values of 4 or more characters that are assigned to a name that tells of a secret. A random forest
of Spark ML judges each by its length, its transitions between kinds of characters, the share that dictionary words
cover, the path it comes from and the words around it. Everything is DataFrame and SQL functions; the forest is trained on
labelled findings, by default on a bounded set that is made from rules below.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch, packed, unpacked

SPACE = r"[\x20\x09-\x0D]+"
#: A run of value characters (padding only at its end), and what follows it.
RUN, BETWEEN = r"([A-Za-z0-9_+/~.-]+(?:={1,2}(?![A-Za-z0-9_+/~.\-=\"'`]))?)", r"([^A-Za-z0-9_+/~.-]*)"
LONG = 12

# Words that tell something in a path, a name or a neighbour, and in a value. Fixed values.
SECRET_WORDS = ("access", "apikey", "auth", "bearer", "credential", "key", "passwd", "password", "private", "pwd", "secret", "token")
#: A name of a secret, its assignment, and a value of any characters but borders; the password in a URL.
_NAMED = r"(?i)([A-Za-z0-9_.-]{0,40}(?:" + "|".join(SECRET_WORDS) + r")[A-Za-z0-9_.-]{0,40})[\"'`\])]{0,2}[=:]+[\"'`(\[{]{0,2}([^\s\"'`&,;(){}\[\]<>]{4,})"
_IN_URL = r"://[^/@:\s]*:([^@/\s]{4,})@"
#: The end of the words before a value that stands alone.
_NAMED_BEFORE = r"(?i)(?:" + "|".join(SECRET_WORDS) + r")[A-Za-z0-9_.-]{0,40}[\"'`\])]{0,2} ?[=:]+$"
HARMLESS_WORDS = ("build", "checksum", "commit", "digest", "etag", "hash", "id", "integrity", "md5", "ref", "revision", "sha", "sha1", "sha256", "sha512", "trace", "uuid", "version")
TEST_PATHS = ("demo", "doc", "docs", "example", "examples", "fixture", "fixtures", "mock", "readme", "sample", "spec", "test", "tests")
DICTIONARY = (
    "access", "account", "admin", "api", "application", "auth", "backup", "build", "cache", "change", "client", "cloud", "config", "content", "count", "data", "database", "date", "debug", "default", "demo", "deploy", "dev", "development",
    "document", "domain", "dummy", "enter", "example", "fake", "field", "file", "foo", "group", "handler", "header", "hello", "here", "host", "image", "index", "input", "insert", "item", "key", "label", "latest", "level", "library",
    "list", "local", "login", "main", "manager", "master", "message", "model", "module", "name", "node", "number", "object", "order", "output", "page", "param", "pass", "password", "path", "placeholder", "prod", "production", "profile",
    "project", "query", "record", "release", "replace", "report", "request", "response", "result", "sample", "schema", "secret", "server", "service", "session", "setting", "snapshot", "source", "staging", "state", "status", "string",
    "system", "table", "target", "task", "temp", "template", "test", "text", "thread", "time", "token", "type", "update", "user", "value", "version", "view", "web", "widget", "word", "world", "xxx", "your",
)
PREFIXES = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|ghs_|github_pat_|glpat-|hf_|npm_|sk-|sk_live_|rk_live_|xox[abp]-|eyJ)"

FEATURES = ["length", "digits", "upper", "lower", "other", "hex", "variety", "syllables", "lower_digit", "digit_lower", "lower_upper", "upper_lower", "upper_digit", "digit_upper", "coverage", "prefix", "test_path", "near_secret", "near_harmless", "assigned"]
#: Labelled findings that the forest is trained on, at most.
FINDINGS = 20_000


def _any(text: Column, words: tuple[str, ...]) -> Column:
    """1.0 where one of the words stands alone in the text, in any case and between any other characters than letters."""
    return F.coalesce(F.lower(text).rlike(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])"), F.lit(False)).cast("double")


def features(findings: DataFrame) -> DataFrame:
    """findings (value, before, after, name, path) with the columns FEATURES; nulls count as empty."""
    v = F.coalesce("value", F.lit(""))
    n = F.greatest(F.length(v), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / n

    near = F.concat_ws(" ", "before", "name")
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    return findings.withColumns({
        "length": F.least(n, F.lit(128.0)), "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "other": share("[^A-Za-z0-9]"),
        "hex": v.rlike("^[0-9a-f]+$").cast("double"), "variety": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64.0)), "syllables": F.regexp_count(F.lower(v), F.lit("[bcdfghjklmnpqrstvwxz][aeiou]")) / n,
        "lower_digit": share("[a-z](?=[0-9])"), "digit_lower": share("[0-9](?=[a-z])"), "lower_upper": share("[a-z](?=[A-Z])"), "upper_lower": share("[A-Z](?=[a-z])"), "upper_digit": share("[A-Z](?=[0-9])"), "digit_upper": share("[0-9](?=[A-Z])"),
        "coverage": (n - F.length(F.regexp_replace(F.lower(v), words, ""))) / n, "prefix": v.rlike(PREFIXES).cast("double"),
        "test_path": _any(F.col("path"), TEST_PATHS), "near_secret": _any(near, SECRET_WORDS), "near_harmless": _any(F.concat_ws(" ", near, "after"), HARMLESS_WORDS),
        "assigned": ((F.coalesce("name", F.lit("")) != "") | F.coalesce(F.col("before"), F.lit("")).rlike("[=:]$")).cast("double"),
    })


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """doc_id, text_hash, word_no (from 0), value, before (up to two words), after, name and path of every candidate in docs (doc_id, text).

    Null and empty texts have none. Rows that repeat a doc_id each give theirs.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), (F.col(path) if path else F.lit("")).cast("string").alias("path"))

    def before(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.get(w, i - 2), F.get(w, i - 1))

    def fits(w: Column, i: Column) -> Column:
        word = F.get(w, i)
        long = (F.length(word) >= LONG) & word.rlike(f"[A-Za-z0-9_+/~.-]{{{LONG}}}")
        return long | (word.rlike("[=:]") & (word.rlike(_NAMED) | word.rlike(_IN_URL))) | (F.get(w, i - 1).rlike("[=:]$") & before(w, i).rlike(_NAMED_BEFORE))

    def around(w: Column, i: Column) -> Column:
        return F.struct(i.alias("word_no"), F.get(w, i).alias("word"), before(w, i).alias("before"), F.get(w, i + 1).alias("after"))

    # The words are the variable of a lambda, so that they are split once and not for each use.
    words = F.split(F.coalesce("text", F.lit("")), SPACE)
    one_text = F.transform(F.array(words), lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: fits(w, i)), lambda i: around(w, i)))
    found = docs.select("doc_id", "text_hash", "path", F.flatten(one_text).alias("c"))
    one = found.select("doc_id", "text_hash", "path", F.explode("c").alias("c")).select("doc_id", "text_hash", "path", "c.*")

    def values(names: Column, own: Column) -> Column:
        return F.transform(F.arrays_zip(names.alias("name"), own.alias("value")), lambda x: F.struct(x["value"].alias("value"), x["name"].alias("name")))

    # The whole values of names of secrets, then all runs of value characters that aren't part of one of these.
    word, every = F.col("word"), F.lit(RUN + BETWEEN)
    url = F.transform(F.regexp_extract_all(word, F.lit(_IN_URL), F.lit(1)), lambda v: F.struct(v.alias("value"), F.lit("password").alias("name")))
    alone = F.regexp_extract(word, r"""^["'`(\[{<]*([^"'`&,;(){}\[\]<>]{4,})""", 1)
    alone = F.when(F.col("before").rlike(_NAMED_BEFORE) & (F.length(alone) >= 4), F.array(F.struct(alone.alias("value"), F.lit("").alias("name")))).otherwise(F.array().cast("array<struct<value:string,name:string>>"))
    named = values(F.regexp_extract_all(word, F.lit(_NAMED), F.lit(1)), F.regexp_extract_all(word, F.lit(_NAMED), F.lit(2)))
    runs, between = F.regexp_extract_all(word, every, F.lit(1)), F.regexp_extract_all(word, every, F.lit(2))
    one = one.withColumns({"_named": F.concat(url, named, alone), "_runs": runs, "_between": between})
    assigned = r"""^["'`\])]?[=:]+["'`(\[{]*$"""
    long = F.transform("_runs", lambda v, k: F.struct(v.alias("value"), F.when((k > 0) & F.get("_between", k - 1).rlike(assigned), F.get("_runs", k - 1)).otherwise(F.lit("")).alias("name")))
    trimmed = lambda a: F.transform(a, lambda x: F.struct(F.regexp_replace(x["value"], r"[.!?]+$", "").alias("value"), x["name"].alias("name")))
    one = one.withColumns({"_named": F.filter(trimmed("_named"), lambda x: F.length(x["value"]) >= 4), "_long": F.filter(trimmed(long), lambda x: (F.length(x["value"]) >= LONG) & x["value"].rlike("[A-Za-z]"))})
    rest = F.filter("_long", lambda x: ~F.exists("_named", lambda y: F.contains(y["value"], x["value"])))
    one = one.select("doc_id", "text_hash", "word_no", "before", "after", "path", F.explode(F.array_distinct(F.concat("_named", rest))).alias("f"))
    return one.select("doc_id", "text_hash", "word_no", "f.value", "before", "after", "f.name", "path")


def labelled_findings(spark: SparkSession, n: int = 8000) -> DataFrame:
    """n findings (value, before, after, name, path, is_secret), made by rule: real forms of secrets in their usual surroundings,
    and what is mistaken for them (digests, identifiers, placeholders, versions, names)."""

    def pick(salt: int, *values: str) -> Column:
        return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))

    def text(salt: int, size: int, alphabet: str) -> Column:
        at = lambda i: (F.pmod(F.xxhash64("id", F.lit(salt), i), F.lit(len(alphabet))) + 1).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.substr(F.lit(alphabet), at(i), F.lit(1))), "")

    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    any_, hex_ = upper + lower + digits, "0123456789abcdef"
    prose = pick(1, "and the", "was of", "then in", "une la", "und der", "los que", "of this", "set the")
    secret_name = pick(2, "password", "token", "api_key", "secret", "access_key", "auth", "passwd", "client_secret", "pwd")
    harmless = pick(3, "commit", "sha256", "md5", "checksum", "revision", "build", "etag", "digest", "sha1")
    word = pick(4, "example", "sample", "your", "dummy", "test", "placeholder", "change", "default")
    word2 = pick(5, "token", "api_key", "secret", "password", "value", "key", "user", "service")
    name = pick(6, "handler", "request", "index", "widget", "message", "module", "snapshot", "release")
    empty, number = F.lit(""), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(100000)).cast("string")
    assigned = F.concat(secret_name, F.lit(" ="))
    syllable = lambda salt: pick(salt, "ba", "con", "de", "er", "fi", "gra", "in", "ka", "lo", "men", "na", "or", "pre", "ri", "se", "ta", "tion", "un", "ver", "zi")
    long_word = F.concat(*(syllable(50 + i) for i in range(6)))
    plain = pick(60, "required", "optional", "missing", "invalid", "expired", "changed", "null", "none", "true", "false", "string", "value", "unknown", "reset", "forgotten", "hidden", "authentication", "documentation", "configuration", "authorization", "unauthorized", "expired-session", "not-available", "undefined")
    natural = pick(61, "internationalization", "responsibilities", "unquestionably", "representatives", "telecommunications", "Geschwindigkeit", "Krankenversicherung", "Zusammenarbeit", "développement", "particulièrement", "investigaciones", "características", "straightforward", "acknowledgement", "Congratulations", "UNBELIEVABLE")
    # kind: value, before, name, is_secret
    kinds = [
        (F.concat(F.lit("AKIA"), text(11, 16, upper + "234567")), prose, empty, 1), (text(12, 18, hex_), prose, secret_name, 1), (text(13, 40, hex_), assigned, empty, 1),
        (text(14, 40, any_ + "+/"), assigned, empty, 1), (F.concat(F.lit("ghp_"), text(15, 36, any_)), prose, empty, 1), (F.concat(F.lit("sk-"), text(16, 32, any_)), prose, secret_name, 1),
        (F.concat(F.lit("eyJ"), text(17, 30, any_), F.lit("."), text(18, 40, any_)), F.lit("authorization: bearer"), empty, 1), (text(19, 16, any_), assigned, secret_name, 1), (text(20, 24, any_ + "_-"), prose, secret_name, 1),
        (text(21, 40, hex_), harmless, empty, 0), (text(22, 32, hex_), F.concat(harmless, F.lit(":")), empty, 0), (text(23, 64, hex_), prose, harmless, 0), (text(24, 12, hex_), harmless, empty, 0), (text(25, 40, hex_), prose, empty, 0),
        (F.concat_ws("-", text(26, 8, hex_), text(27, 4, hex_), text(28, 4, hex_), text(29, 4, hex_), text(30, 12, hex_)), pick(8, "the id", "trace uuid", "and the", "of request"), empty, 0),
        (F.concat(word, F.lit("_"), word2, F.lit("_"), number), prose, secret_name, 0), (F.concat(word, F.lit("-"), word2, F.lit("-here-"), number), assigned, empty, 0),
        (F.concat(name, F.lit("-"), name, F.lit("-2024.01."), number), prose, pick(9, "", "version", "build"), 0), (F.concat(F.initcap(name), F.initcap(word2), F.lit("Handler"), number), prose, empty, 0), (F.concat(F.lit("release/"), name, F.lit("/v"), number, F.lit(".tar.gz")), prose, empty, 0),
        # without digits, long, and short
        (F.concat(F.lit("AKIA"), text(40, 16, upper)), prose, empty, 1), (text(41, 20, upper + lower), assigned, empty, 1), (text(42, 24, lower), prose, secret_name, 1), (text(43, 8, any_), assigned, empty, 1), (text(44, 10, any_ + "!$%@"), prose, secret_name, 1),
        (F.concat(F.lit("eyJ"), text(45, 60, any_), F.lit("."), text(46, 420, any_ + "_-"), F.lit("."), text(47, 43, any_)), prose, secret_name, 1), (text(48, 64, any_ + "+/"), prose, secret_name, 1),
        (long_word, prose, empty, 0), (F.initcap(long_word), prose, empty, 0), (F.upper(long_word), prose, empty, 0), (natural, prose, empty, 0), (plain, assigned, empty, 0), (plain, prose, secret_name, 0), (F.concat_ws("-", name, word2, name), prose, empty, 0),
        (F.concat(F.lit("//"), name, F.lit(".example.org/en/"), number), prose, F.lit("https"), 0), (F.concat(F.lit("src/"), name, F.lit("/"), word2, F.lit(".py")), prose, empty, 0), (F.concat(name, F.lit("."), word2, F.lit(".example.com")), prose, empty, 0), (F.concat(name, F.lit("_"), word2), prose, secret_name, 0),
    ]
    i = F.pmod(F.col("id"), F.lit(len(kinds)))
    made = F.array(*(F.struct(v.alias("value"), b.alias("before"), m.alias("name"), F.lit(s).alias("is_secret")) for v, b, m, s in kinds))
    base = spark.range(n).select("id", F.element_at(made, (i + 1).cast("int")).alias("f"), pick(10, "the", "and", "", "of").alias("after"))
    path = F.when(F.col("f.is_secret") == 0, pick(31, "src", "tests", "docs", "web", "src0")).otherwise(pick(32, "src", "config", "web", "deploy", "src0"))
    return base.select("f.*", "after", path.alias("path"))


def train(findings: DataFrame, trees: int = 40, depth: int = 8, rows: int = FINDINGS, seed: int = 1) -> PipelineModel:
    """A forest trained on findings (value, before, after, name, path, is_secret), at most `rows` of them."""
    scratch = Scratch(findings.sparkSession, "findings")
    findings = scratch.table(findings.select("value", "before", "after", "name", "path", "is_secret"), "labelled")
    used = features(findings.where("value is not null and is_secret is not null").orderBy(F.xxhash64("value", F.lit(seed)), "value").limit(rows))
    used = scratch.table(used.select(*FEATURES, F.col("is_secret").cast("double").alias("label")), "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(used)


def scan(docs: DataFrame, model: PipelineModel, path: str | None = "source", least: float = 0.5) -> DataFrame:
    """doc_id, text_hash, word_no, value, before, after, name, path, probability and is_secret (probability >= least) of every candidate.

    docs: doc_id long, text string, and the column that `path` names; others are ignored. Null and empty texts have no
    candidates; rows that repeat a doc_id each give theirs; an empty table gives an empty result.
    """
    found = Scratch(docs.sparkSession, "secrets").table(candidates(docs, path), "candidates")
    kept = found.columns
    scored = model.transform(features(found)).withColumn("probability", F.round(vector_to_array("probability")[1], 9))
    return scored.select(*kept, "probability", (F.col("probability") >= least).alias("is_secret"))


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs (doc_id, text and any others) with each secret that found, a result of scan, lists for its text written as mark.

    Rows are matched by doc_id and by a hash of the text, so that rows that repeat a doc_id, or have none, keep their own findings.
    A null text stays null; an empty found, or an empty table, changes nothing.
    """
    own = found.where("is_secret").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("value").alias("_values"))
    df = packed(docs, "doc_id", "text").withColumn("_own", F.xxhash64("text"))
    df = df.join(own, df["doc_id"].eqNullSafe(own["_id"]) & (df["_own"] == own["_hash"]), "left")
    # The longest first, as a short one may be part of it.
    longest = F.array_sort("_values", lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0))

    def without(t: Column, v: Column) -> Column:
        """A short value may be part of other words: only whole ones are replaced."""
        whole = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), v, F.lit(r"\E(?![A-Za-z0-9])"))
        return F.when(F.length(v) >= LONG, F.replace(t, v, F.lit(mark))).otherwise(F.regexp_replace(t, whole, F.lit(mark)))

    text = F.when(F.col("_values").isNull(), F.col("text")).otherwise(F.aggregate(longest, F.col("text"), without))
    return df.withColumn("text", text).select(*unpacked(docs.columns, "doc_id", "text"))
