"""Scan for secrets: patterns find candidates, a random forest removes false positives; DataFrame operations alone.

Candidates are values of assignments to telling names, tokens of well-known shapes, private-key headers, and long runs
of key characters that hold letters and digits.  For each one the forest sees its length, the transitions between
classes of its characters (scored by how often labelled secrets and labelled others have them), how much of it a
dictionary covers, its path (the document's source) and the words around it.  The forest is Spark ML's, trained from
labelled findings: a table of (candidate, before, after, path, label); ``labelled_findings`` makes a default one from
rules, of a fixed size.

Cases: a null or empty text has no candidates; a value found twice in a text is two findings, numbered in order;
repeated rows give repeated findings; ids are whole numbers (others fail in the cast), and one id may have any number of
texts; a null path is an empty one; ``redact`` carries other columns along; empty tables
give no rows.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = "<SECRET>"
#: Fixed lists: names that secrets are assigned to, words that tell of something else, and parts of made-up values.
NAMES = "api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|client[_-]?secret|auth[_-]?token|access[_-]?token|token|secret|password|passwd|pwd|credential|authorization|bearer"
OTHERS = "commit|sha1|sha256|sha|md5|checksum|digest|hash|etag|uuid|guid|version|build|revision|tree|blob|integrity|example|sample|dummy|placeholder|session|trace|request"
DICTIONARY = (
    "example placeholder changeme change your insert sample dummy test testing fake mock null none true false default "
    "password secret token key here value user name admin root service account config setting server client public private "
    "hello world foo bar baz lorem ipsum the and for with from this that has was are not you all can get set add new old "
    "read write open close file path data base table index image page view list item node tree state event time date "
    "number string object array method class function return import export module package version license include source"
).split()
#: Tokens of well-known shapes: how they begin, and what follows.  No quantifier has an upper bound: a candidate is always
#: the whole value, and possessive ones see that no text is read twice.
SHAPED = [("AKIA|ASIA", "[A-Z0-9]{16,}+"), ("gh[pousr]_", "[A-Za-z0-9]{36,}+"), ("xox[abprs]-", "[A-Za-z0-9-]{10,}+"), ("sk_(?:live|test)_", "[A-Za-z0-9]{16,}+"), ("eyJ", r"[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+")]
SHAPES = "|".join(f"(?:{begin}){rest}" for begin, rest in SHAPED)
RUNS = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{24,}+={0,2}"
#: A private key from its first line to its last, or, where that is missing, to the end of what looks like its body.
_KEY = r"(?:[A-Z0-9]++ ){0,4}PRIVATE KEY(?: BLOCK)?-----"
HEADER = rf"-----BEGIN {_KEY}(?:[A-Za-z0-9+/=:,.\s-]*?-----END {_KEY}|(?:\s*+[A-Za-z0-9+/=]{{16,}}+)*+)"
#: An assignment: the value is what follows ``LEAD``, up to the closing quote, or else up to white space and without the
#: signs that end a clause.
LEAD = r"""["']?\s*+(?:=>|:=|=|:)\s*+"""
VALUE = r"""(?:"[^"\r\n]{8,}+(?=")|'[^'\r\n]{8,}+(?=')|["']?+[^\s"'`<>]{7,}[^\s"'`<>,;.)\]}])"""
#: A whole match of any kind.
MATCH = rf"{HEADER}|(?i:{NAMES}){LEAD}{VALUE}|\b(?:{SHAPES})|{RUNS}"
#: A text without any of these holds no match, and needs no closer look: each alternative of MATCH has its beginning here.
HINT = f"PRIVATE KEY|(?i:{NAMES})|{'|'.join(begin for begin, _ in SHAPED)}|[A-Za-z0-9+/_-]{{24}}"
CONTEXT = 48
CLASSES = "vcudo"  # vowel, consonant, upper case, digit, other
FEATURES = ["f_length", "f_transitions", "f_changes", "f_digits", "f_upper", "f_other", "f_distinct", "f_hex", "f_dictionary", "f_path", "f_name", "f_assigned", "f_elsewhere", "f_quoted", "f_shape"]


def _classes(value: Column) -> Column:
    out = F.regexp_replace(value, "[A-Z]", "U")
    out = F.regexp_replace(out, "[aeiouy]", "V")
    out = F.regexp_replace(out, "[a-z]", "c")
    out = F.regexp_replace(out, "[0-9]", "d")
    out = F.regexp_replace(out, "[^UVcd]", "o")
    return F.translate(out, "UV", "uv")


def _share(value: Column, pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace(value, pattern, "")) / F.greatest(F.length(value), F.lit(1))


def _pairs(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - 1, F.lit(1))), lambda i: F.substr(value, i, F.lit(2)))


def transitions(labelled: DataFrame) -> dict[str, float]:
    """Log odds of each pair of character classes in labelled secrets against others (25 numbers)."""
    pairs = labelled.select("label", F.explode(_pairs(_classes(F.col("candidate")))).alias("pair"))
    counts = {(r["pair"], int(r["label"])): r["count"] for r in pairs.groupBy("pair", "label").count().collect()}
    total = {k: sum(n for (_, x), n in counts.items() if x == k) + 25 for k in (0, 1)}
    return {a + b: math.log((counts.get((a + b, 1), 0) + 1) / total[1]) - math.log((counts.get((a + b, 0), 0) + 1) / total[0]) for a in CLASSES for b in CLASSES}


def featured(findings: DataFrame, odds: dict[str, float]) -> DataFrame:
    """Add the features of (candidate, before, after, path)."""
    value, before = F.col("candidate"), F.lower(F.col("before"))
    classes = _classes(value)
    table = F.create_map(*[F.lit(x) for pair in odds.items() for x in pair])
    scored = F.aggregate(_pairs(classes), F.lit(0.0), lambda a, p: a + F.coalesce(table[p], F.lit(0.0)))
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    n = F.greatest(F.length(value), F.lit(1))
    columns = {
        "f_length": F.length(value),
        "f_transitions": scored / n,
        "f_changes": F.length(F.regexp_replace(classes, r"(.)(?=\1)", "")) / n,
        "f_digits": _share(value, "[0-9]"),
        "f_upper": _share(value, "[A-Z]"),
        "f_other": _share(value, "[^A-Za-z0-9]"),
        "f_distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "f_hex": value.rlike("^[0-9a-f]+$|^[0-9A-F]+$"),
        "f_dictionary": _share(F.lower(value), words),
        "f_path": F.lower(F.coalesce("path", F.lit(""))).rlike("test|spec|mock|fixture|example|sample|doc"),
        "f_name": before.rlike(rf"(?:{NAMES})\W*$") | value.rlike("^-----BEGIN"),
        "f_assigned": before.rlike(r"[=:]\s*[\"']?$"),
        "f_elsewhere": before.rlike(OTHERS) | F.lower(F.col("after")).rlike(rf"^\W*(?:{OTHERS})"),
        "f_quoted": before.rlike("[\"']$") & F.col("after").rlike("^[\"']"),
        "f_shape": value.rlike(rf"^(?:{SHAPES})$") | value.rlike("^-----BEGIN"),
    }
    return findings.withColumns({k: c.cast("double") for k, c in columns.items()})


def labelled_findings(spark: SparkSession, n: int = 6000, seed: int = 7) -> DataFrame:
    """A default training table from rules: made-up secrets of usual kinds, and what is often mistaken for one."""

    def draw(k: int, upto: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(upto)).cast("int")

    def text(alphabet: str, least: int, most: int, k: int) -> Column:
        size = F.lit(least) + draw(k, most - least + 1)
        letter = lambda i: F.substr(F.lit(alphabet), F.pmod(F.xxhash64("id", F.lit(seed + k), i), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), size), letter), "")

    def one_of(values: list[str], k: int) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), draw(k, len(values)) + 1)

    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, full = digits + "abcdef", lower + upper + digits
    word = lambda k: one_of([*DICTIONARY, "report", "summer", "window", "garden", "handler", "adapter"], k)
    name = one_of(["token", "api_key", "secret", "password", "client_secret", "access_token", "auth_token", "apikey"], 1)
    sign = one_of([' = "', ": '", "=", ' := "', '": "', " = "], 2)
    quote = one_of(['"', "'", '",', "", ";", " and"], 3)
    other = one_of(["commit ", "sha256: ", "md5=", "checksum ", "etag: \"", "uuid=", "build ", "request ", "", "the ", "in ", "see "], 4)
    uuid = F.concat_ws("-", text(hexa, 8, 8, 30), text(hexa, 4, 4, 31), text(hexa, 4, 4, 32), text(hexa, 4, 4, 33), text(hexa, 12, 12, 34))
    joined = F.call_function("concat_ws", one_of(["_", "-", "", "/", "."], 40), word(41), word(42), word(43), word(44))
    camel = F.concat(word(45), F.initcap(word(46)), F.initcap(word(47)), F.initcap(word(48)), draw(49, 90).cast("string"))
    kinds: list[tuple[Column, Column, int]] = [
        (text(hexa, 32, 64, 10), F.concat(name, sign), 1),
        (text(full, 20, 48, 11), F.concat(name, sign), 1),
        (text(full + "+/", 40, 88, 12), F.concat(name, sign), 1),
        (F.concat(F.lit("AKIA"), text(upper + digits, 16, 16, 13)), one_of(["", "aws ", "id = ", "key: "], 5), 1),
        (F.concat(F.lit("ghp_"), text(full, 36, 36, 14)), one_of(["", "use ", "token=", "git "], 6), 1),
        (F.concat(F.lit("sk_live_"), text(full, 24, 32, 15)), one_of(["", "stripe ", "key = '"], 7), 1),
        (text(lower + digits + "!_-", 10, 20, 16), F.concat(F.lit("password"), sign), 1),
        (text(full + "!$%&*#@^?", 10, 24, 17), F.concat(one_of(["password", "secret", "pwd", "passwd"], 9), sign), 1),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), text(full + "+/", 64, 200, 18), F.lit("\n-----END RSA PRIVATE KEY-----")), one_of(["", "key: ", "see "], 80), 1),
        (F.concat(F.lit("-----BEGIN "), one_of(["", "EC ", "RSA ", "OPENSSH "], 81), F.lit("PRIVATE KEY-----")), one_of(["", "key: ", "see "], 82), 1),
        (text(hexa, 32, 64, 20), other, 0),
        (uuid, other, 0),
        (joined, F.concat(name, sign), 0),
        (joined, other, 0),
        (camel, other, 0),
        (F.concat_ws(" ", word(83), word(84), word(85), word(86)), F.concat(name, sign), 0),
        (F.concat(word(87), one_of(["", "s", "ed", "ing", "ment"], 88), one_of(["", ",", ":", "?"], 89)), F.concat(name, one_of([": ", " = ", "="], 90)), 0),
        (F.concat(one_of(["your_", "my_", "insert_", "example_"], 50), joined), F.concat(name, sign), 0),
        (F.concat(word(51), F.lit("/"), word(52), F.lit("/"), word(53), F.lit("/"), word(54), draw(55, 900).cast("string")), other, 0),
        (F.regexp_replace(text("x", 12, 40, 21), "x", "x"), F.concat(name, sign), 0),
        (text(digits, 12, 20, 22), one_of(["card ", "phone ", "id=", "order "], 8), 0),
    ]
    rows = spark.range(0, n, 1, 2)
    kind = draw(0, len(kinds))
    pick = lambda i: F.element_at(F.array(*(k[i] if isinstance(k[i], Column) else F.lit(k[i]) for k in kinds)), kind + 1)
    lead = F.concat(word(60), F.lit(" "), word(61), F.lit(" "))
    path = F.when(pick(2) == 0, one_of(["src0", "web", "tests/data", "docs/readme", "src7"], 70)).otherwise(one_of(["src0", "web", "config/app", "src3", "deploy"], 71))
    return rows.select(pick(0).alias("candidate"), F.concat(lead, pick(1)).alias("before"), quote.alias("after"), path.alias("path"), pick(2).cast("double").alias("label"))


class SecretModel:
    def __init__(self, forest: RandomForestClassificationModel, odds: dict[str, float]):
        self.forest, self.odds = forest, odds

    def apply(self, findings: DataFrame) -> DataFrame:
        """Add probability to (candidate, before, after, path)."""
        assembled = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(featured(findings, self.odds))
        out = self.forest.transform(assembled)
        return out.select(*findings.columns, vector_to_array("probability")[1].alias("probability"))


def fit(labelled: DataFrame, *, trees: int = 24, depth: int = 8, seed: int = 7) -> SecretModel:
    labelled = labelled.where("candidate is not null and label is not null").select("candidate", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), "path", F.col("label").cast("double").alias("label"))
    odds = transitions(labelled)
    data = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(featured(labelled, odds))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return SecretModel(forest.fit(data.select("features", "label")), odds)


def candidates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, text_key, path, number, start, candidate, before, after): every candidate with the characters around it."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.coalesce(F.col(path), F.lit("")).alias("path"), body.alias("_text")).where(F.col("_text").rlike(HINT))
    # the whole of each match, and what lies between matches: the place of each is the length of all before it
    found = rows.withColumn("_all", F.regexp_extract_all("_text", F.lit(MATCH), F.lit(0))).where(F.size("_all") > 0)
    pairs = F.zip_with("_all", F.slice(F.split("_text", MATCH, -1), F.lit(1), F.size("_all")), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    places = F.aggregate(
        pairs,
        F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<at:int,m:string>>").alias("got")),
        lambda a, p: F.struct((a["next"] + p["gap"] + F.length(p["m"])).alias("next"), F.concat(a["got"], F.array(F.struct((a["next"] + p["gap"]).alias("at"), p["m"].alias("m")))).alias("got")),
        lambda a: a["got"],
    )
    each = found.select("doc_id", "text_key", "path", "_text", F.posexplode(places).alias("number", "hit"))
    lead = F.regexp_extract(F.col("hit.m"), rf"^(?i:{NAMES}){LEAD}[\"']?", 0)
    each = each.withColumn("_lead", F.length(lead))
    start = F.col("hit.at") + F.col("_lead")
    value = F.substr(F.col("hit.m"), F.col("_lead") + 1)
    return each.select(
        "doc_id",
        "text_key",
        "path",
        "number",
        (start - 1).cast("long").alias("start"),
        value.alias("candidate"),
        F.substr(F.col("_text"), F.greatest(start - CONTEXT, F.lit(1)), start - F.greatest(start - CONTEXT, F.lit(1))).alias("before"),
        F.substr(F.col("_text"), start + F.length(value), F.lit(CONTEXT)).alias("after"),
    )


def scan(docs: DataFrame, model: SecretModel, *, least: float = 0.5, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, text_key, number, start, length, candidate, probability, is_secret): every candidate with the forest's verdict."""
    judged = model.apply(candidates(docs, doc_id=doc_id, text=text, path=path))
    return judged.select("doc_id", "text_key", "number", "start", F.length("candidate").cast("long").alias("length"), "candidate", "probability", (F.col("probability") >= least).alias("is_secret"))


def redact(docs: DataFrame, model: SecretModel, *, least: float = 0.5, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """``docs`` with every secret replaced by a mask, all other columns kept (n_chars is counted anew if there).

    Secrets are masked where they were found and nowhere else.
    """
    secrets = scan(docs, model, least=least, doc_id=doc_id, text=text, path=path).where("is_secret")
    places = F.array_sort(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"))))
    lists = secrets.groupBy(F.col("doc_id").alias("id"), "text_key").agg(places.alias("places"))
    keyed = docs.select(F.struct(*docs.columns).alias("d"), F.col(doc_id).cast("long").alias("i"), F.xxhash64(F.col(text)).alias("k"), F.coalesce(F.col(text).rlike(HINT), F.lit(False)).alias("touched"))
    joined = keyed.where("touched").join(lists, F.equal_null("i", "id") & (F.col("k") == F.col("text_key")), "left")
    body = F.col("d")[text]

    def cut(done: Column, place: Column) -> Column:
        return F.struct((place["start"] + place["length"]).alias("at"), F.concat(done["out"], F.substr(body, done["at"] + 1, place["start"] - done["at"]), F.lit(MASK)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("places", start, cut, lambda done: F.concat(done["out"], F.substr(body, done["at"] + 1)))
    row = F.col("d").withField(text, F.coalesce(masked, body))
    if "n_chars" in docs.columns:
        count = F.length(F.coalesce(masked, body)).cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.col("d.n_chars").isNotNull(), count))
    return keyed.where("not touched").select("d.*").unionByName(joined.select(row.alias("d")).select("d.*"))
