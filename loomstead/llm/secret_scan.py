"""Secret scan (operator 2): candidate strings, features of each and its surroundings, and a random forest
that removes false positives.

A candidate is a run of 16 or more characters of `[A-Za-z0-9+/_=-]` with a digit (without one too behind "token is"),
inside one word, or a value of any kind of four or more characters that is assigned to a name like password or token,
however short or plain, or that stands as the password of an address. A run that covers an assigned value is none of its own. Features: length,
shares of digits, capitals and other characters, distinct characters, character transitions and how likely they are
in words, dictionary coverage, signs of a path or address, the path of the file, and what the neighbouring words say.
Word likeness comes from the corpus itself: letter pairs of all its words (26 x 26 numbers), and the DICTIONARY words
that are most frequent. The forest learns from labelled findings; TRAINING of them (the bound of the training set) are
made by rule below when the caller gives none. Built-in functions and the forest's own JVM code only; the one shuffle
is that of distinct words, no Python on the executors.

Defined results: null and empty texts have no findings; a string that occurs twice is found twice, at its
own word each time; a null key is kept; a null path says nothing; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut

#: Rows of the training set, trees and depth of the forest, its seed, the probability from which a finding stands, and
#: words of the dictionary.
TRAINING, TREES, DEPTH, SEED, THRESHOLD, DICTIONARY = 8000, 32, 9, 11, 0.5, 2000

CANDIDATE = "[A-Za-z0-9+/_=\\-]{16,}"
LETTERS = "abcdefghijklmnopqrstuvwxyz"

#: Words that speak for a secret, words that speak against one, values that stand for one, paths that hold examples
#: (fixed values).
SECRET_WORDS = "key|token|secret|passw|pwd|auth|credential|api|bearer|private|access|login"
OTHER_WORDS = "commit|sha|md5|hash|checksum|uuid|guid|isbn|order|invoice|phone|card|account|rev|id|digest|etag"
PLACEHOLDERS = "none|null|nil|true|false|required|optional|example|sample|your|change|placeholder|secret|password|token|xxx|todo|test|env|process|config"
EXAMPLE_PATHS = "test|spec|mock|fixture|example|sample|docs?/|readme|lock"

#: A name that speaks of a secret and what it is given: inside a word, and as the value's own word (patterns).
IN_WORD = f"(?i)(?:{SECRET_WORDS})[A-Za-z0-9_\\-]*[\"'`\\]]*(?::=|=>|==|[:=])[\"'`(]*([^\"'`()\\[\\];,]{{4,}})"
NAMES = f"(?i)(?:{SECRET_WORDS})[A-Za-z0-9_\\-]*[\"'`\\]]*"
ASSIGNS = ":=|=>|==|[:=]"
#: The password of an address: scheme, user, colon, value (a pattern).
IN_ADDRESS = "://[^/\\s:@]*:([^/\\s@]{4,})@"
VALUE = "^[\"'`(]*([^\"'`()\\[\\];,]{4,})"


def _n(c: Column) -> Column:
    return c.cast("double")


def _listed(values: list[str]) -> Column:
    """A list of words as one literal that is split once, so that plans stay small."""
    return F.split(F.lit(" ".join(values)), " ")


class Words:
    """What a corpus says of words: log probabilities of letter pairs (27 x 27, the 27th for a word's edge) and its most
    frequent words of four letters or more."""

    def __init__(self, pairs: list[float], frequent: list[str]):
        self.pairs, self.frequent = pairs, frequent


def corpus_words(docs: DataFrame, text: str = "text", most: int = DICTIONARY) -> Words:
    """Words of all texts, counted by word first, so that what is collected is bounded whatever the corpus."""
    t = F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    counts = docs.select(F.explode(F.split(t, "[^a-z]+")).alias("w")).where("length(w) BETWEEN 2 AND 24").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts)
    frequent = [r.w for r in counts.where("length(w) >= 4").orderBy(F.desc("n"), "w").limit(most).collect()]
    edged = F.concat(F.lit("{"), "w", F.lit("{"))  # the character after z
    pairs = counts.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(edged, i, F.lit(2)))).alias("p")).groupBy("p").agg(F.sum("n").alias("n")).collect()
    table = [[0.5] * 27 for _ in range(27)]
    for r in pairs:
        table[ord(r.p[0]) - 97][ord(r.p[1]) - 97] += r.n
    return Words([math.log(x / sum(row)) for row in table for x in row], frequent)


def _in_dictionary(part: Column, words: list[str]) -> Column:
    """Whether a part of letters is one of the words: only those of its first two letters are looked through."""
    groups = [","] * (26 * 26)
    for w in words:
        at = (ord(w[0]) - 97) * 26 + ord(w[1]) - 97
        groups[at] += w + ","
    at = (F.ascii(part) - 97) * 26 + F.ascii(F.substring(part, 2, 1)) - 96
    return F.when(F.length(part) >= 4, F.element_at(_listed(groups), at).contains(F.concat(F.lit(","), part, F.lit(",")))).otherwise(False)


def _likelihood(c: Column, words: Words) -> Column:
    """Mean log probability of the letter pairs in the candidate's letter runs; that of even letters without any."""
    table = _listed([repr(x) for x in words.pairs]).cast("array<double>")
    plain = F.regexp_replace(F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+", " ")
    edged = F.concat(F.lit("{"), F.translate(F.trim(plain), " ", "{"), F.lit("{"))
    code = lambda i: F.ascii(F.substring(edged, i, F.lit(1))) - 97
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.length(edged) - 1, F.lit(1))), lambda i: F.element_at(table, code(i) * 27 + F.greatest(code(i + 1), F.lit(0)) + 1))
    return F.when(F.length(edged) > 2, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.size(steps)).otherwise(math.log(1 / 27))


def with_features(found: DataFrame, words: Words) -> tuple[DataFrame, list[str]]:
    """found: word, before3, before2, before1, after1, path (strings), candidate and assigned. Adds the feature columns."""
    c, size = F.col("candidate"), F.length("candidate")
    digits = size - F.length(F.translate(c, "0123456789", ""))
    upper = size - F.length(F.translate(c, LETTERS.upper(), ""))
    lower = size - F.length(F.translate(c, LETTERS, ""))
    classes = F.translate(c, "0123456789" + LETTERS.upper() + LETTERS, "0" * 10 + "A" * 26 + "a" * 26)
    around = F.lower(F.concat_ws(" ", "before3", "before2", "before1"))
    head = F.expr("substring_index(word, candidate, 1)")
    near = F.lower(F.concat_ws(" ", "before1", head))
    parts = F.split(F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    known = F.filter(parts, lambda x: _in_dictionary(x, words.frequent))
    features = {
        "size": size,
        "digits": digits / size,
        "upper": upper / size,
        "lower": lower / size,
        "other": (size - digits - upper - lower) / size,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(62)),
        "transitions": (F.length(F.regexp_replace(classes, "(.)\\1+", "$1")) - 1) / F.greatest(size - 1, F.lit(1)),
        "likelihood": _likelihood(c, words),
        "coverage": F.aggregate(F.transform(known, lambda x: F.length(x)), F.lit(0), lambda s, x: s + x) / size,
        "hex": c.rlike("^[0-9a-f]+$|^[0-9A-F]+$"),
        "numeric": digits == size,
        "longest_letters": F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), lambda x: F.length(x))) / size,
        "slashes": F.size(F.split("word", "/")) - 1,
        "dashes": F.size(F.split(c, "-")) - 1,
        "placeholder": c.rlike(f"(?i)^[<${{%]|^\\W*(?:{PLACEHOLDERS})"),
        "repeated": c.rlike("^(.)\\1{3,}"),
        "address": F.col("word").rlike("(?i)https?:|www\\.|@|\\.(com|org|net|html?|png|jpe?g|css|js|py|txt)\\b"),
        "inside": F.length("word") > size + 6,
        "quoted": head.rlike("[\"'`]$"),
        "given": F.concat_ws(" ", "before1", head).rlike("[=:]\\s*[\"'`(]*$"),
        "assigned": F.col("assigned"),
        "secret_near": near.rlike(SECRET_WORDS),
        "secret_around": around.rlike(SECRET_WORDS),
        "other_near": near.rlike(f"\\b({OTHER_WORDS})\\b"),
        "prefix": c.rlike("^(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk[-_]|pk_|eyJ|AIza|glpat-)"),
        "example_path": F.lower("path").rlike(EXAMPLE_PATHS),
        "code_path": F.lower("path").rlike("\\.(env|ya?ml|json|toml|ini|cfg|conf|py|js|ts|rb|go|java|sh|properties)$"),
    }
    return found.select("*", *[F.coalesce(_n(v), F.lit(0.0)).alias(f"f_{k}") for k, v in features.items()]), [f"f_{k}" for k in features]


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, word_index, nth, candidate, assigned, word, before3, before2, before1, after1, path) of every candidate."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    where = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path else F.lit("")
    speaks = F.col("_t").rlike(f"(?i){SECRET_WORDS}")
    words = docs.select(F.col(f"`{key}`").alias("_id"), where.alias("path"), t.alias("_t")).where(F.col("_t").rlike("[0-9]") | speaks | F.col("_t").rlike(IN_ADDRESS)).select("_id", "path", speaks.alias("_speaks"), F.split("_t", SPACE_CLASS + "+").alias("w"))
    at = lambda i: F.coalesce(F.try_element_at("w", F.when(i > 0, i)), F.lit(""))  # noqa: E731  1-based, empty outside
    long_ = F.filter(F.transform("w", lambda x, i: F.when((F.length(x) >= 16) & x.rlike("[0-9]") | x.rlike(IN_ADDRESS), i)), lambda i: i.isNotNull())
    names = F.filter(F.transform("w", lambda x, i: F.when(x.rlike(f"(?i){SECRET_WORDS}"), i)), lambda i: i.isNotNull())
    marked = words.select("_id", "path", "w", long_.alias("_long"), F.when(F.col("_speaks"), names).otherwise(F.array().cast("array<int>")).alias("_names"))
    # a value stands in its name's word, in the next one, or behind a lone sign of assignment
    spots = F.flatten(F.transform("_names", lambda p: F.array(p, p + 1, p + 2)))
    marked = marked.select("_id", "path", "w", F.array_distinct(F.concat("_long", F.filter(spots, lambda p: p < F.size("w")))).alias("at")).where(F.size("at") > 0)
    each = marked.select("_id", "path", "w", F.explode("at").alias("i"))
    pick = lambda d: at(F.col("i") + 1 + d)
    near = each.select("_id", F.col("i").cast("bigint").alias("word_index"), "path", pick(0).alias("word"), pick(-3).alias("before3"), pick(-2).alias("before2"), pick(-1).alias("before1"), pick(1).alias("after1"))
    named = F.col("before1").rlike(f"^(?:{ASSIGNS})$") & F.col("before2").rlike(f"{NAMES}$") | F.col("before1").rlike(f"{NAMES}(?:{ASSIGNS})$")
    first_of = lambda p: F.when(F.regexp_extract("word", p, 1) != "", F.regexp_extract("word", p, 1))
    value = F.coalesce(first_of(IN_WORD), first_of(IN_ADDRESS))
    value = F.when(value.isNotNull(), value).when(named, F.regexp_extract("word", VALUE, 1))
    near = near.withColumn("_value", F.when(value != "", value))
    said = F.lower("before1").isin("is", "is:") & F.col("before2").rlike(f"{NAMES}$")
    # a run lies in the value, or comes up to it through the sign of assignment
    front = F.regexp_extract("_value", "^[A-Za-z0-9+/_=\\-]+", 0)
    covers = lambda x: F.col("_value").contains(x) | ((front != "") & x.contains(F.concat(F.lit("="), front)))
    runs = F.filter(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0)), lambda x: (x.rlike("[0-9]") | said) & ~F.coalesce(covers(x), F.lit(False)))
    given = F.when(F.col("_value").isNull(), F.array().cast("array<string>")).otherwise(F.array("_value"))
    found = near.select("*", F.posexplode(F.concat(given, runs)).alias("nth", "candidate"))
    return found.withColumn("assigned", F.coalesce((F.col("nth") == 0) & F.col("_value").isNotNull(), F.lit(False))).drop("_value").withColumnRenamed("_id", key)


def labelled_findings(spark: SparkSession, n: int = TRAINING, seed: int = SEED, words: list[str] | None = None) -> DataFrame:
    """n labelled findings by rule: secrets in public formats with their usual surroundings, and what is mistaken for
    them. `words` are those of plain values, slugs and passphrases."""
    plain = (words or [])[:400] or ["report", "example", "content", "version", "article", "release", "user", "home"]
    r = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}-{k}"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("bigint")
    one_of = lambda k, *options: F.element_at(F.array(*[F.lit(x) for x in options]), (r(k) % len(options) + 1).cast("int"))
    sha = lambda k: F.sha1(F.concat_ws(":", F.lit(f"{seed}-{k}"), F.col("id").cast("string")).cast("binary"))
    b64 = lambda k, size: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(sha(k), sha(k + "+")))), "[\\r\\n]", ""), 1, size)
    number = lambda k, size: F.rpad(F.concat(r(k).cast("string"), r(k + "+").cast("string")), size, "7")
    word = lambda k: F.element_at(_listed(plain), (r(k) % len(plain) + 1).cast("int"))
    slug = F.concat(word("s1"), F.lit("-"), word("s2"), F.lit("-"), (r("s3") % 10000).cast("string"))
    name = one_of("n", "token", "api_key", "secret", "password", "auth_token", "ACCESS_KEY", "client_secret")
    hexes = F.substring(F.concat(sha("h"), sha("h2")), 1, one_of("hs", 32, 40, 40, 64))
    uuid = F.regexp_replace(sha("u"), "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5")
    kind = F.col("id") % 24
    cased = F.when(r("case") % 5 == 0, F.upper(hexes)).otherwise(hexes)
    short = F.concat(b64("pw", 5), one_of("ps", "!", "$", "%", "#", "*", "."), b64("pw2", 4), (r("pn") % 90 + 10).cast("string"))
    joint = one_of("pj", "-", ".", "_")
    phrase = F.concat(word("w1"), joint, word("w2"), joint, word("w3"), joint, word("w4"))
    value = (
        F.when(kind.isin(0, 1, 2), cased).when(kind == 3, b64("b", 40)).when(kind == 4, F.concat(F.lit("AKIA"), F.upper(F.substring(b64("a", 60), 1, 16))))
        .when(kind == 5, F.concat(F.lit("ghp_"), F.regexp_replace(b64("g", 36), "[+/=]", "x"))).when(kind == 6, F.concat(F.lit("sk-"), F.regexp_replace(b64("k", 48), "[+/=]", "y"))).when(kind == 7, b64("p", 24))
        .when(kind.isin(8, 9), F.substring(number("d", 19), F.lit(1), one_of("dn", 13, 15, 16, 16, 19))).when(kind == 10, F.concat(F.lit("https://example.com/"), slug, F.lit("/page-"), number("pg", 6)))
        .when(kind == 11, uuid).when(kind == 12, F.substring(sha("c"), 1, 40)).when(kind == 13, F.concat(F.lit("/assets/static/"), slug, F.lit("/img_"), number("im", 8), F.lit(".png")))
        .when(kind == 14, F.concat(F.lit("user"), number("em", 14), F.lit("@mail.example.com"))).when(kind.isin(15, 16), short).when(kind == 17, phrase)
        .when(kind == 18, one_of("pl", "none", "null", "required", "your_password", "<password>", "${SECRET}", "xxxxxxxx", "os.environ", "example", "********")).when(kind == 19, word("pv"))
        .when(kind == 20, F.concat(word("k1"), F.lit("."), word("k2"))).when(kind == 22, F.when(r("ud") % 2 == 0, b64("up", 12)).otherwise(F.concat(b64("up", 6), one_of("us", "!", "$", "*", "."), b64("up2", 4))))
        .when(kind == 23, one_of("uh", "password", "password", "xxxx", "example", "<password>", "${PASSWORD}", "changeme", "secret", "********")).otherwise(F.concat(slug, F.lit("-"), slug))
    )
    filler = lambda k: F.when(r(k) % 2 == 0, word(k + "w")).otherwise(one_of(k, "the", "of", "and", "in", "x", "a", "|"))
    form, secret, assigned = r("form") % 4, (kind < 8) | kind.isin(15, 16, 17, 22), kind.between(15, 20)
    in_address = kind.isin(22, 23)
    form = F.when(assigned & (form == 2), 3).otherwise(form)
    behind = kind.isin(8, 9, 10, 13, 21) & (form == 3)  # what follows a secret is none for that
    before3 = F.when(in_address, filler("f3")).when(secret & (form == 3), F.concat(F.lit("my "), name)).when(behind, name).otherwise(filler("f3"))
    before2 = F.when(in_address, filler("f2")).when((secret | assigned) & (form < 2), name).when(behind, F.lit("=")).otherwise(filler("f2"))
    before1 = F.when(in_address, one_of("ua", "connect", "url", "=", "to", "DATABASE_URL:", "at")).when(behind, F.concat(F.lit('"'), hexes, F.lit('"'), one_of("bq", "", ";", "###"))).when((secret | assigned) & (form < 2), one_of("eq", "=", "=", ":", ":=")).when(secret & (form == 2), F.concat(name, F.lit(":"))).when(kind == 12, one_of("cm", "commit", "sha1", "checksum", "revision")).when(secret, F.lit("is")).otherwise(filler("f1"))
    address = F.concat(one_of("uc", "postgres", "mysql", "redis", "https", "amqp"), F.lit("://"), word("uu"), F.lit(":"), F.regexp_replace(value, "/", "x"), F.lit("@"), word("ud2"), one_of("ut", ".example.com", ":5432", ""), F.lit("/"), word("un"))
    wrapped = (
        F.when(in_address, address).when((secret | assigned) & (form < 2) & (r("q") % 3 < 2), F.concat(F.lit('"'), value, F.lit('"'), one_of("t", "", "", ";", ",", "###")))
        .when((secret | assigned) & (form == 3), F.concat(name, F.lit("="), value)).otherwise(F.concat(value, one_of("t2", "", "", ".", ",", "!!")))
    )
    where = F.when(r("path") % 3 == 0, one_of("pp", "src/app.py", "deploy/prod.env", "config.yaml")).when((r("path") % 3 == 1) & ~secret, one_of("pt", "tests/test_app.py", "docs/readme.md", "yarn.lock")).otherwise("")
    rows = spark.range(0, n, 1, 1).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", before3, before2, before1, wrapped, filler("fa")).alias("text"), where.alias("path"), value.alias("_value"), secret.cast("double").alias("label"),
    )
    rows = cut(rows)
    found = candidates(rows, "doc_id", "text", "path").join(rows.select("doc_id", "_value", "label"), "doc_id")
    # what the scan itself cuts out of the text, if it is of the labelled value
    same = F.col("_value").contains(F.col("candidate")) | F.col("candidate").contains(F.col("_value"))
    return found.where(same).drop("_value", "doc_id", "word_index", "nth")


def train(labelled: DataFrame, words: Words) -> RandomForestClassificationModel:
    """A forest from labelled findings (the columns of with_features' input and label 0 or 1)."""
    rows, names = with_features(labelled, words)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", maxBins=32)
    held = cut(rows.select(vector_to_array("features").alias("x"), "label")).coalesce(1).sortWithinPartitions("x", "label")
    return forest.fit(held.select(array_to_vector("x").alias("features"), "label"))


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", labelled: DataFrame | None = None, threshold: float = THRESHOLD, path: str | None = None) -> DataFrame:
    """One row per candidate: key, word_index, nth (in its word), candidate, size, assigned, probability, is_secret."""
    words = corpus_words(docs, text)
    model = train(labelled_findings(docs.sparkSession, words=words.frequent) if labelled is None else labelled, words)
    rows, names = with_features(candidates(docs, key, text, path), words)
    scored = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    p = vector_to_array("probability")[1]
    return scored.select(key, "word_index", F.col("nth").cast("bigint").alias("nth"), "candidate", F.length("candidate").cast("bigint").alias("size"), "assigned", p.alias("probability"), (p >= threshold).alias("is_secret"))
