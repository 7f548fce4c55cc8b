"""Secret scans: candidates by pattern, and a random forest that removes the false ones."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliograph.session import scratch_path, settle

SHORTEST = 16
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}"
NEAR = 40  # characters on either side of a candidate that tell about it
# Forms of secrets that need no context, and names that stand before one.
KNOWN = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})$"
NAMED = "token|secret|password|passwd|pwd|api_?key|access_?key|private_?key|auth|bearer|credential"
NAMES = rf"(?i)({NAMED})s?$"
# What stands before a value of any length: such a name and an assignment, four characters at least; and the value.
ASSIGNMENT = rf"(?i:{NAMED})[sS]?[\"']?[ \t]*+[:=]{{1,2}}+[ \t]*+[\"']?+"
VALUE = r"(?<=\")[^\s\"]+|(?<=')[^\s']+|(?<![\"'])[^\s\"'](?:\S*[^\s,;])?"
ASSIGNED = rf"({ASSIGNMENT})(?=({VALUE})([\s\S]{{0,{NEAR}}}))"
PLACEHOLDER = "^([A-Z]?[a-z]+|[A-Z]+|[0-9]+)$"
SHARE = 1 / 2000  # words of three to eight letters that are so much of all of them are ordinary text, so 2,000 words at most
SEEDS = 200  # examples of each made-up form
SAMPLE = 20_000  # labelled findings of each kind a forest is trained on, at most
TREES, DEPTH = 20, 6
ACCEPT = 0.5

CHARACTERS = ["length", "transitions", "common_pairs", "distinct", "digits", "capitals", "signs", "coverage", "vowels", "in_path"]
WORDS = ["words_left", "words_right"]
CONTEXT = ["assigned", "quoted", "named", "plain_left", "plain_right"]  # what labels without findings are made of
FEATURES = [*CHARACTERS, *WORDS, *CONTEXT]


def _near(gaps: str, hits: str, i: Column, n: int) -> tuple[Column, Column]:
    """NEAR characters of the text before and after hit ``i``: of gaps, with hits between them, ``n`` of which are that long."""

    def piece(side, name: str, at: Column) -> Column:
        return F.coalesce(side(F.get(name, at), F.lit(NEAR)), F.lit(""))

    left = [piece(F.right, name, i - d) for d in range(n, 0, -1) for name in (gaps, hits)] + [piece(F.right, gaps, i)]
    right = [piece(F.left, gaps, i + 1)] + [piece(F.left, name, i + at) for d in range(1, n + 1) for name, at in ((hits, d), (gaps, d + 1))]
    return F.right(F.concat(*left), F.lit(NEAR)), F.left(F.concat(*right), F.lit(NEAR))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, secret, left, right) of each candidate: its place in characters from 0, and 40 characters on either side,
    other candidates included.

    Candidates are long runs of the characters secrets are made of, and what is assigned to a telling name, of any length
    and with any signs but blanks: in quotes up to the same one, else without a comma or semicolon at its end. What is both
    is one candidate.
    """
    docs = docs.select("doc_id", "text")
    return _runs(docs).unionByName(_assigned(docs))


def _runs(docs: DataFrame) -> DataFrame:
    """The text is cut at the candidates once; a place is the length of all that comes before."""
    each = _cut(docs.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))), CANDIDATE, F.col("found"))
    left, right = _near("parts", "found", F.col("i"), -(-NEAR // SHORTEST))
    start = F.get("ends", F.col("i")) + F.length(F.get("parts", F.col("i")))
    return each.select("doc_id", start.cast("bigint").alias("start"), "secret", left.alias("left"), right.alias("right"))


def _assigned(docs: DataFrame) -> DataFrame:
    """The text is cut at names and assignments, so that a value may hold another name. Values that are runs are left out."""
    some = docs.where(F.col("text").rlike(ASSIGNED))
    found, values, after = (F.regexp_extract_all("text", F.lit(ASSIGNED), F.lit(k)) for k in (1, 2, 3))
    each = _cut(some.withColumns({"found": found, "values": values, "after": after}), ASSIGNED, F.col("values"))
    left, _ = _near("parts", "found", F.col("i"), -(-NEAR // 4))
    own = F.get("found", F.col("i"))
    return each.where(~F.col("secret").rlike(f"^(?:{CANDIDATE})$")).select(
        "doc_id",
        F.get("ends", F.col("i") + 1).cast("bigint").alias("start"),
        "secret",
        F.right(F.concat(left, own), F.lit(NEAR)).alias("left"),
        F.get("after", F.col("i")).alias("right"),
    )


def _cut(hits: DataFrame, pattern: str, secret: Column) -> DataFrame:
    """A row for each hit ``i`` of ``found``, with the parts of the text between hits and ``ends``, where each hit ends, from 0 on."""
    parts = hits.where(F.col("found").isNotNull()).withColumn("parts", F.split("text", pattern)).drop("text")
    sizes = F.transform("found", lambda x, i: F.length(F.get("parts", i)) + F.length(x))
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    placed = parts.withColumn("ends", ends)
    return placed.select("*", F.posexplode_outer(secret).alias("i", "secret")).where("secret is not null")


def frequent_words(docs: DataFrame, share: float = SHARE) -> list[str]:
    """The words of three to eight letters a-z that make up at least ``share`` of all such words, so 1 / ``share`` words at most."""
    every = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b[a-z]{3,8}\b"), F.lit(0))).alias("w"))
    counts = settle(every.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return sorted(r["w"] for r in counts.where(F.col("n") >= share * total).select("w").collect())


def with_features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """Numbers about each candidate: its characters and their transitions (between kinds, and those usual in words), the share that dictionary words cover, path and neighbouring words."""
    size = F.greatest(F.length("secret"), F.lit(1))
    kinds = F.translate("secret", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)

    def share(pattern: str) -> Column:
        return (size - F.length(F.regexp_replace("secret", pattern, ""))) / size

    ordered = sorted(dictionary, key=lambda w: (-len(w), w))
    known = F.regexp_replace(F.lower("secret"), "|".join(ordered), "") if ordered else F.lower("secret")
    pairs = sorted({w[i : i + 2] for w in dictionary for i in range(len(w) - 1)})  # 676 at most
    common = F.regexp_count(F.lower("secret"), F.lit(f"(?=(?:{'|'.join(pairs)}))")) if pairs else F.lit(0)
    covered = "|".join(ordered) or "(?!)"

    def plain(side: str) -> Column:
        letters = F.lower(F.regexp_replace(side, r"\s", ""))
        return (F.length(letters) - F.length(F.regexp_replace(letters, covered, ""))) / F.greatest(F.length(letters), F.lit(1))

    before = F.regexp_extract("left", r"([A-Za-z0-9_-]+)[\"']?\s*[:=]*\s*[\"']?$", 1)
    columns = {
        "length": F.length("secret").cast("double"),
        "transitions": F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) / size,
        "common_pairs": common / size,
        "distinct": F.size(F.array_distinct(F.split("secret", ""))) / size,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "signs": share("[^A-Za-z0-9]"),
        "coverage": (size - F.length(known)) / size,
        "vowels": share("[aeiouAEIOU]"),
        "in_path": (F.col("secret").contains("/") | F.col("left").rlike(r"[/.\\]$") | F.col("right").rlike(r"^[/.][A-Za-z]")).cast("double"),
        "words_left": plain("left"),
        "words_right": plain("right"),
        "assigned": F.col("left").rlike(r"[:=]\s*[\"']?$").cast("double"),
        "quoted": F.col("left").rlike(r"[\"']$").cast("double"),
        "named": before.rlike(NAMES).cast("double"),
        "plain_left": F.col("left").rlike(r"(^|\s)$").cast("double"),
        "plain_right": F.col("right").rlike(r"^(\s|$)").cast("double"),
    }
    return found.withColumns({name: F.coalesce(value, F.lit(0.0)) for name, value in columns.items()})


def label_by_context(found: DataFrame) -> DataFrame:
    """``label`` of what its surroundings tell: 1 for what is assigned to a telling name, 0 for what stands between blanks and after
    no name; NULL for all else, and for a word or number after such a name, which may be a placeholder. The forms that services
    give their keys are 1 wherever they stand."""
    told = (F.col("named") == 1) & (F.col("assigned") == 1) & ~F.col("secret").rlike(PLACEHOLDER)
    prose = (F.col("named") == 0) & (F.col("assigned") == 0) & (F.col("plain_left") == 1) & (F.col("plain_right") == 1)
    return found.withColumn("label", F.when(F.col("secret").rlike(KNOWN) | told, 1.0).when(prose, 0.0))


def seeds(spark: SparkSession, dictionary: list[str]) -> DataFrame:
    """Made-up findings of both labels, so that no corpus lacks one: digests, random letters and short passwords against numbers,
    ordinary words, words joined to names, and paths. They have no surroundings."""
    digest = F.sha2(F.concat(F.lit("seed "), F.col("id").cast("string")).cast("binary"), 512)
    signs = F.translate(F.base64(F.unhex(digest)), "+/=", "Zq7")
    size, kind = (F.col("id") % 25).cast("int"), (F.col("id") % 4).cast("int")
    listed = F.lit([w for w in dictionary] or ["example", "value", "name"])

    def word(at: int) -> Column:
        return F.element_at(listed, (F.pmod(F.xxhash64(F.col("id"), F.lit(at)), F.size(listed)) + 1).cast("int"))

    def joined(sign: Column | str) -> Column:
        return F.concat_ws(sign, *[word(i) for i in range(4)])

    sign = F.element_at(F.lit(["!", "#", "%", "."]), kind + 1)
    secret = [F.left(digest, 16 + 8 * kind), F.left(signs, 16 + size), F.concat(F.left(signs, 4 + kind), sign, F.right(signs, F.lit(3)), F.right(F.translate(digest, "abcdef", ""), F.lit(2)))]
    plain = [F.left(F.translate(digest, "abcdef", ""), 3 + size), word(0), joined(""), joined("_"), F.concat(F.lit("/"), joined("/"))]
    forms = [F.struct(v.alias("secret"), F.lit(label).alias("label")) for values, label in ((secret, 1.0), (plain, 0.0)) for v in values]
    return spark.range(SEEDS).select(F.explode(F.array(*forms)).alias("s")).select("s.*", F.lit("").alias("left"), F.lit("").alias("right"))


def train(labelled: DataFrame, features: list[str], sample: int = SAMPLE) -> RandomForestClassificationModel:
    """A forest on ``labelled`` findings (features and label 0 or 1): of each kind those of the smallest digest, up to ``sample``.

    The forest is saved to the shared folder and read again: a fitted one holds its session, which cannot be sent to executors.
    """
    told = labelled.where("label is not null").select(*features, "label", F.xxhash64("secret", "left", "right").alias("_h"))
    kinds = [told.where(F.col("label") == k).orderBy("_h", *features).limit(sample) for k in (0.0, 1.0)]
    rows = settle(kinds[0].unionByName(kinds[1]))
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="sqrt")
    saved = scratch_path(labelled.sparkSession, "forest")
    forest.fit(vectors.select("features", "label")).save(saved)
    return RandomForestClassificationModel.load(saved)


def scan(docs: DataFrame, labelled: DataFrame | None = None, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, start, secret, score) of the secrets in ``docs`` (doc_id, text): every candidate the forest does not reject.

    ``labelled`` findings (the columns of ``candidates`` and label) train the forest by all features. Without them the findings are labelled
    by what stands before and after, made-up ones are added, and the forest sees what no label was made of: the characters and how ordinary
    the words nearby are. Made-up findings also stand for a label that ``labelled`` lacks. Whole texts are searched. NULL and empty texts
    have no candidate; repeated rows give repeated findings; ids are carried as they are. Other columns are ignored, and an empty table
    gives an empty table.
    """
    docs = docs.select("doc_id", "text")
    dictionary = frequent_words(docs)
    found = settle(with_features(candidates(docs), dictionary))
    made = with_features(seeds(docs.sparkSession, dictionary), dictionary)
    if labelled is None:
        features = [*CHARACTERS, *WORDS]
        taught = label_by_context(found).select(*made.columns).unionByName(made)
    else:
        features, given = FEATURES, with_features(labelled, dictionary).select(*made.columns)
        present = [r["label"] for r in given.select("label").distinct().collect()]
        taught = given.unionByName(made.where(~F.col("label").isin(present) if present else F.lit(True)))
    model = train(taught, features)
    judged = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(found))
    scored = judged.withColumn("score", vector_to_array("probability")[1])
    return scored.where(F.col("score") >= accept).select("doc_id", "start", "secret", F.round("score", 6).alias("score"))
