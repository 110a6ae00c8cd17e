"""Secret scans: a random forest takes false positives out of what a pattern finds.

Candidates are long runs of key characters with a digit, and values set to a name such as
password.  The forest sees a candidate's length, its character transitions, how much of it
dictionary words cover, its path and its neighbouring words.  It is trained on labelled findings
(a bounded table) with Spark's own trainer, then written out as one SQL expression of its trees,
so that scanning is a projection: no Python, no shuffle, linear in a text's length.

Defined results: null and empty texts have no findings; a null path is an empty one; a secret that
comes twice in a text is two findings; repeated rows are scanned each on its own; a text without
candidates is never scored; other columns are kept by `redact` and not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled findings that are generated, and the most that are used of a given table.
LABELLED_ROWS = 3000
MAX_LABELLED_ROWS = 50_000
TREES, TREE_DEPTH = 24, 7
#: Share of the trees' votes from which a candidate is a secret.
THRESHOLD = 0.5
#: Characters of text on each side in which neighbouring words are looked for.
NEIGHBOURS = 40

_NAMES = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
#: A run of key characters with a digit, or a value that is set to such a name: the name may go on,
#: and quotes and blanks may stand round the sign.  The short look back comes first as it is cheap.
CANDIDATE = (
    r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+"
    r"|(?<=[=:>\s\"'])(?<=[=:>]\s{0,8}[\"']?)(?<=" + _NAMES + r"[A-Za-z0-9_-]{0,16}[\"']?\s{0,8}(?:[=:]{1,2}|=>)\s{0,8}[\"']?)(?![=:>])[^\s\"',;]{8,}+"
)
# Words that make a string readable rather than random.
_DICTIONARY = """access account admin api auth backup branch build cache change client cloud commit config content copy credential data database date
default demo dev docker document download dummy email example fake false field file folder foo github global hello here home host html http image
img index info insert item java key lib license local login main master message mock model module name node null number object option order
packages page param pass password path placeholder point post private prod project public python query random readme release report request
resource root sample script secret server service session setting shared site source spec src staging static string style system table target
temp test text title token tool true type update upload user value version view web with world www xxx your""".split()
_SECRET_WORDS = r"(?i)(pass(word|wd)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|auth|credential|bearer|private)"
_OTHER_WORDS = r"(?i)(commit|sha-?\d*|md5|checksum|hash|digest|uuid|guid|revision|build|etag|isbn|order|invoice|base64|version|serial|tracking|ref)"
_TEST_PATH = r"(?i)(^|[^a-z])(tests?|spec|fixtures?|mocks?|examples?|samples?|docs?|demo)([^a-z]|$)"
_CHANGES = r"(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])|(?<=[A-Za-z0-9])(?=[_+/-])|(?<=[_+/-])(?=[A-Za-z0-9])"
_PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk_live_|rk_live_|sk-|xox[abp]-|AIza|glpat-|npm_|eyJ)"


def _share(c: Column, pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace(c, pattern, "")) / F.length(c)


def features(c: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """The forest's inputs, by name, as doubles."""
    low = F.lower(c)
    out = {
        "length": F.length(c),
        "changes": (F.size(F.split(c, _CHANGES)) - 1) / F.length(c),
        "letter_turns": (F.size(F.split(low, "(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])")) - 1) / F.length(c),
        "digits": _share(c, "[0-9]"),
        "capitals": _share(c, "[A-Z]"),
        "marks": _share(c, "[^A-Za-z0-9]"),
        "hex": F.when(low.rlike("^[0-9a-f]+$"), 1).otherwise(0),
        "uuid": F.when(low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), 1).otherwise(0),
        "distinct": F.size(F.array_distinct(F.split(low, ""))) / F.least(F.length(c), F.lit(20)),
        "dictionary": _share(low, "(" + "|".join(sorted(_DICTIONARY, key=lambda w: (-len(w), w))) + ")"),
        "prefix": F.when(c.rlike(_PREFIXES), 1).otherwise(0),
        "secret_words": F.when(F.right(before, F.lit(24)).rlike(_SECRET_WORDS), 1).otherwise(0),
        "other_words": F.when(F.right(before, F.lit(24)).rlike(_OTHER_WORDS), 1).otherwise(0),
        "assigned": F.when(before.rlike(r"[=:]\s*[\"']?$"), 1).otherwise(0),
        "quoted": F.when(before.rlike(r"[\"']$") & after.rlike(r"^[\"']"), 1).otherwise(0),
        "test_path": F.when(path.rlike(_TEST_PATH), 1).otherwise(0),
    }
    return {k: v.cast("double") for k, v in out.items()}


# --- labelled findings ----------------------------------------------------------------------


def labelled_findings(spark: SparkSession, rows: int = LABELLED_ROWS, seed: int = 1) -> DataFrame:
    """Generated findings with their labels: candidate, before, after, path, label.

    Real kinds of secrets, and the strings that are taken for them: hashes of commits and files,
    ids, placeholders, numbers, paths, inline data and secrets of test files.
    """
    df = spark.range(rows).withColumn("h", F.sha2(F.concat_ws("/", F.lit(seed), "id"), 256)).withColumn("g", F.sha2(F.concat_ws("\\", F.lit(seed), "id"), 256))

    def number(at: int, n: int) -> Column:
        return F.conv(F.substring("g", at, 4), 16, 10).cast("int") % n

    def pick(at: int, *of: str) -> Column:
        return F.element_at(F.array(*map(F.lit, of)), number(at, len(of)) + 1)

    hex_, other = F.col("h"), F.col("g")
    base36 = F.lpad(F.upper(F.concat(F.conv(F.substring(hex_, 1, 15), 16, 36), F.conv(F.substring(hex_, 17, 15), 16, 36), F.conv(F.substring(hex_, 33, 15), 16, 36))), 36, "7")
    mixed = F.regexp_replace(F.base64(F.unhex(hex_)), "[=+/\\s]", "")
    word = pick(5, *_DICTIONARY[::3])
    word2 = pick(9, *_DICTIONARY[1::3])
    plain = pick(13, "and of the ", "lorem ipsum ", "is here: ", "", "to use ", "nt erth in ", "de la ")
    name = pick(17, "token", "password", "secret", "api_key", "TOKEN", "apikey", "access_key", "auth_token", "PASSWORD")
    sets = F.concat(plain, name, pick(21, " = \"", "=", ": ", "=\"", ": '", " = "))
    noun = pick(25, "commit ", "sha1: ", "checksum = ", "md5 ", "build ", "hash: ", "revision ", "etag=\"", "digest=")
    ids = pick(29, "uuid=", "id: ", "guid ", "ref ", "serial: ", "tracking ")
    mark = pick(57, "_", "-", "/")
    kinds = [  # (candidate, before, secret)
        (F.concat(F.lit("AKIA"), F.substring(base36, 2, 16)), pick(33, "anre orshin ", "key ", "aws_access_key_id = ", ""), 1),
        (F.substring(hex_, 1, 40), sets, 1),
        (F.expr("substring(h, 1, 16 + conv(substring(g, 33, 2), 16, 10) % 9)"), sets, 1),
        (F.concat(F.lit("ghp_"), F.substring(F.concat(mixed, mixed), 1, 36)), F.when(number(37, 2) == 0, sets).otherwise(plain), 1),
        (F.substring(mixed, 1, 40), sets, 1),
        (F.concat(pick(41, "sk_live_", "xoxb-", "glpat-", "npm_"), F.substring(mixed, 3, 24)), plain, 1),
        (F.concat(F.lit("AKIA"), F.substring(base36, 3, 16)), plain, 1),
        (F.concat(F.initcap(word), F.substring(mixed, 1, 10)), sets, 1),
        (F.substring(hex_, 1, 40), F.concat(plain, noun), 0),
        (F.substring(hex_, 1, 32), F.concat(plain, noun), 0),
        (F.concat_ws("-", F.substring(hex_, 1, 8), F.substring(hex_, 9, 4), F.substring(hex_, 13, 4), F.substring(hex_, 17, 4), F.substring(hex_, 21, 12)), F.when(number(45, 2) == 0, plain).otherwise(ids), 0),
        (pick(49, "your_token_here_123", "xxxxxxxxxxxxxxxx0000", "example_key_1234567", "changeme_password1", "0000000000000000", "placeholder_secret_1", "<your-password>", "test_password_123", "dummy_token_000000"), sets, 0),
        (F.expr("substring(translate(h, 'abcdef', '172839'), 1, 16 + conv(substring(g, 33, 2), 16, 10) % 6)"), F.when(number(53, 2) == 0, ids).otherwise(plain), 0),
        (F.concat(word, mark, word2, mark, pick(61, "data", "file", "image", "version", "module"), mark, number(1, 3000).cast("string")), plain, 0),
        (F.concat(F.lit("iVBORw0KGgo"), mixed, mixed), F.concat(plain, F.lit("base64,")), 0),
        (F.substring(hex_, 1, 40), sets, 0),
    ]
    kind = F.col("id") % len(kinds)
    pack = F.when(F.lit(False), F.struct(F.lit("").alias("candidate"), F.lit("").alias("before"), F.lit(0).alias("label")))
    for k, (c, before, label) in enumerate(kinds):
        pack = pack.when(kind == k, F.struct(c.alias("candidate"), before.alias("before"), F.lit(label).alias("label")))
    path = F.when(kind == len(kinds) - 1, pick(2, "tests/unit/app.py", "src/test/data.json", "docs/examples/readme.md", "fixtures/config.yml")).otherwise(
        pick(6, "src0", "src7", "src/main/app.py", "config/prod.yml", "web", "", "deploy/values.yaml", "notes.txt")
    )
    quote = F.regexp_extract(F.col("x.before"), r"([\"'])$", 1)
    return df.withColumn("x", pack).select("x.candidate", "x.before", F.concat(quote, pick(10, " and", "", "\nthe", ".")).alias("after"), path.alias("path"), "x.label")


# --- the forest -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """Trees as nested tuples (feature, threshold, at most, above) with leaves 0.0 or 1.0."""

    names: tuple[str, ...]
    trees: tuple

    def votes(self, x: Column) -> Column:
        """Share of the trees that vote for a secret; x: a struct of the features."""

        def expr(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, at, low, high = node
            return F.when(x[self.names[feature]] <= at, expr(low)).otherwise(expr(high))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + expr(t)
        return total / len(self.trees)


_IF = re.compile(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-0-9.Ee]+)\)")
_PREDICT = re.compile(r"( *)Predict: ([0-9.]+)")


def _parse(lines: list[str]):
    line = lines.pop(0)
    if m := _PREDICT.match(line):
        return float(m[2])
    m = _IF.match(line)
    low = _parse(lines)
    lines.pop(0)
    high = _parse(lines)
    return low if low == high else (int(m[2]), float(m[4]), low, high)


def train(labelled: DataFrame, *, trees: int = TREES, depth: int = TREE_DEPTH, seed: int = 7) -> Forest:
    """labelled: candidate, before, after, path, label; rows with nulls in candidate or label are left out."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    text = [F.coalesce(F.col(c), F.lit("")) for c in ("before", "after", "path")]
    inputs = features(F.col("candidate"), *text)
    rows = labelled.select("candidate", "before", "after", "path", "label").where("candidate is not null and candidate <> '' and label is not null")
    rows = labelled.sparkSession.createDataFrame(rows.take(MAX_LABELLED_ROWS), rows.schema).coalesce(1)
    rows = rows.select(F.col("label").cast("double").alias("label"), *(v.alias(k) for k, v in inputs.items()))
    rows = VectorAssembler(inputCols=list(inputs), outputCol="x").transform(rows).select("label", "x")
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)
    out, now = [], []
    for line in model.toDebugString.split("\n")[1:] + ["Tree"]:
        if line.strip().startswith("Tree"):
            if now:
                out.append(_parse(now))
            now = []
        elif line.strip():
            now.append(line)
    return Forest(tuple(inputs), tuple(out))


def default_forest(spark: SparkSession) -> Forest:
    return train(labelled_findings(spark))


# --- scanning -------------------------------------------------------------------------------


def _with_findings(df: DataFrame, text: str, path: Column, forest: Forest) -> DataFrame:
    """df with _parts (text between candidates), _found (candidates) and _votes, null where there are none."""
    df = df.withColumn("_found", F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0)))
    df = df.withColumn("_parts", F.when(F.size("_found") > 0, F.split(F.col(text), CANDIDATE, -1)))
    df = df.withColumn("_path", F.coalesce(path.cast("string"), F.lit("")))

    def one(c: Column, i: Column) -> Column:
        before = F.right(F.get("_parts", i), F.lit(NEIGHBOURS))
        after = F.left(F.get("_parts", i + 1), F.lit(NEIGHBOURS))
        return F.struct(*(v.alias(k) for k, v in features(c, before, after, F.col("_path")).items()))

    df = df.withColumn("_inputs", F.when(F.col("_parts").isNotNull(), F.transform("_found", one)))
    return df.withColumn("_votes", F.transform("_inputs", forest.votes))


def scan(docs: DataFrame, forest: Forest | None = None, *, path: str = "source") -> DataFrame:
    """One row per finding: doc_id, finding (its number in the text), length, shown (masked), sha256, score, is_secret."""
    forest = forest or default_forest(docs.sparkSession)
    df = docs.select("doc_id", "text", F.col(path).alias("_source") if path in docs.columns else F.lit("").alias("_source"))
    df = _with_findings(df, "text", F.col("_source"), forest).where(F.size("_found") > 0)
    rows = df.select("doc_id", F.posexplode(F.arrays_zip(F.col("_found").alias("c"), F.col("_votes").alias("v"))))
    return rows.select(
        "doc_id",
        F.col("pos").cast("long").alias("finding"),
        F.length("col.c").cast("long").alias("length"),
        F.concat(F.left("col.c", F.lit(4)), F.lit("...")).alias("shown"),
        F.sha2("col.c", 256).alias("sha256"),
        F.round("col.v", 6).alias("score"),
        (F.col("col.v") >= THRESHOLD).alias("is_secret"),
    )


def redact(docs: DataFrame, forest: Forest | None = None, *, path: str = "source", mark: str = "[SECRET]", length: str | None = None) -> DataFrame:
    """docs with every secret in text replaced by mark; column `length`, if named, counts the new text's characters."""
    forest = forest or default_forest(docs.sparkSession)
    names = docs.columns
    df = docs.select(F.struct(*names).alias("_row"), F.col("text").alias("_t"), F.col(path).alias("_source") if path in names else F.lit("").alias("_source"))
    df = _with_findings(df, "_t", F.col("_source"), forest)
    pieces = F.transform("_parts", lambda p, i: F.concat(p, F.when(F.get("_votes", i) >= THRESHOLD, F.lit(mark)).otherwise(F.coalesce(F.get("_found", i), F.lit("")))))
    df = df.withColumn("_new", F.when(F.exists("_votes", lambda v: v >= THRESHOLD), F.array_join(pieces, "")).otherwise(F.col("_t")))
    out = []
    for n in names:
        if n == "text":
            out.append(F.col("_new").alias(n))
        elif n == length:
            out.append(F.when(F.col("_row")[n].isNull() | F.col("_new").isNull(), F.col("_row")[n]).otherwise(F.length("_new")).cast(docs.schema[n].dataType).alias(n))
        else:
            out.append(F.col("_row")[n].alias(n))
    return df.select(*out)
