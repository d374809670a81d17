"""Secret scan with a random forest that removes false positives; DataFrame operations only.

A candidate is the value of 8 characters or more that is assigned to a credential's name
(upper or lower case, the name and the value in quotes or not), or a run of at least 12
key-like characters with a digit; of ``NAME=value`` it is the value. A forest trained from labelled findings scores each
candidate by its length, its character classes and their changes, the likelihood of its
character pairs under the corpus's own words, how much of it dictionary words
cover, its path and the words next to it.

The dictionary and the character pairs are counted over all texts. The forest is
trained on at most about ``TRAINING`` labelled findings (a documented bound).

Defined cases: a null or empty text has no candidates; a null path is the empty path;
repeated rows give repeated findings; a text of any length is searched whole, a key may be as
long as it likes, and a value lies at most ``BLANKS`` blanks after its sign; an empty table gives an empty result; without
labelled findings of both kinds no forest can be trained, ``score`` is null and every
candidate stays; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import checkpointed, text_of

TRAINING = 20_000
DICTIONARY = 1500
TREES, DEPTH, SEED = 24, 6, 17
NEIGHBOURS = 64
#: Blanks at most on either side of the sign between a name and its value: a look-behind needs a bound.
BLANKS = 32
#: A candidate stays if the forest gives it this much.
STAYS = 0.5
_RUN = "A-Za-z0-9+/_-"
_KEY = "A-Za-z0-9+/=_-"
_NAMES = "token|secret|passwd|password|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credential|auth|bearer"
#: The same names as plain strings, optional signs written out.
_SPELLED = [n.replace("[_-]?", sign) for n in _NAMES.split("|") for sign in (("", "_", "-") if "[_-]?" in n else ("",))]
_QUOTE = r"\\?[\"']"
_SIGN = r"(?:[=:]=?|=>)"
#: From a credential's name to its value: NAME=, "name": ', name => and the like.
_ASSIGNED = rf"(?:{_NAMES})(?:{_QUOTE})?[ \t]{{0,{BLANKS}}}{_SIGN}[ \t]{{0,{BLANKS}}}"
_DIGIT = r"(?=[A-Za-z+/=_-]*+[0-9])"
#: In quotes to the closing quote; otherwise to white space, the next field of a query string or the last punctuation.
_VALUE = (
    r"(?<=\")[^\"\r\n]{8,}?(?=\\?\")|(?<=')[^'\r\n]{8,}?(?=\\?')"
    rf"|(?![=>]|{_QUOTE})(?:[^\s\"'&]{{8,}}(?=&[A-Za-z_][\w.-]{{0,40}}=)|[^\s\"']{{7,}}[^\s\"',;.)\]}}>]|[^\s\"']{{8,}})"
)
#: NAME= before a value that is a candidate itself: no part of a run, so that the value has its name before it.
_LEFT = (
    rf"(?:[A-Za-z_-]*+(?:[0-9][A-Za-z_-]*+){{0,2}}|[A-Za-z0-9_-]*(?i:{_NAMES}))=(?!=){_DIGIT}[{_KEY}]{{12}}"
    rf"|[A-Za-z0-9_-]*(?i:{_NAMES})=(?!=)(?:{_QUOTE})?[^\s\"'][^\"'\r\n]{{7}}"
)
#: Short look-behinds first: few places need the long one.
CANDIDATE = (
    rf"(?<=[\s\"'=:>])(?<=[=:>][ \t]{{0,{BLANKS}}}(?:{_QUOTE})?)(?<=(?i:{_ASSIGNED})(?:{_QUOTE})?)(?:{_VALUE})"
    rf"|(?<![{_RUN}])(?!=)(?!{_LEFT}){_DIGIT}[{_KEY}]{{12,}}"
)
_FEATURES = [
    "length", "digits", "upper", "lower", "signs", "hex", "runs", "distinct", "pairs", "covered", "path_length",
    "path_test", "path_code", "path_bucket", "named", "assigned", "quoted", "benign",
]


def candidates(docs: DataFrame, *ids: str, path: str = "source") -> DataFrame:
    """``ids, path, nth, candidate, before, after``: every candidate with 48 characters on either side; no shuffle."""
    ids = ids or ("doc_id",)
    rows = docs.select(
        *[F.col(f"`{i}`") for i in ids], F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("path"),
        text_of("`text`").alias("_text"),
    )
    # what no candidate can be in goes before the pattern: those that are no assignment have a digit
    low, sign = F.lower("_text"), F.col("_text").rlike("[0-9]")
    for name in _SPELLED:
        sign = sign | low.contains(name)
    rows = rows.where(sign)
    rows = rows.withColumn("_found", F.regexp_extract_all("_text", F.lit(CANDIDATE), 0)).where(F.size("_found") > 0)
    rows = rows.withColumn("_between", F.split("_text", CANDIDATE, -1)).drop("_text")
    sides = F.transform(F.col("_between"), lambda b: F.struct(F.right(b, F.lit(48)).alias("end"), F.left(b, F.lit(48)).alias("start")))
    rows = rows.select(*ids, "path", "_found", sides.alias("_sides"))
    return rows.select(*ids, "path", "_sides", F.posexplode("_found").alias("nth", "candidate")).select(
        *ids, "path", "nth", "candidate", F.get("_sides", F.col("nth"))["end"].alias("before"),
        F.get("_sides", F.col("nth") + 1)["start"].alias("after"),
    )


@dataclass
class Words:
    """What the corpus's words say: a dictionary and the log-likelihood of character pairs (both of bounded size)."""

    dictionary: list[str]
    pairs: dict[str, float]


def words_of(docs: DataFrame, size: int = DICTIONARY) -> Words:
    """Counted over all texts: the ``size`` commonest words of four letters or more, and all pairs of a-z and 0-9."""
    found = F.explode(F.regexp_extract_all(F.lower(text_of("`text`")), F.lit(r"[a-z]{4,24}"), 0))
    counts = docs.select(found.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(counts)
    dictionary = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]
    # every word is weighted by its count; the table of pairs has at most 36 x 36 rows
    two = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    pairs = counts.select(F.explode(two).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    first: dict[str, int] = {}
    for r in pairs:
        first[r["pair"][0]] = first.get(r["pair"][0], 0) + r["n"]
    import math

    return Words(dictionary, {r["pair"]: math.log((r["n"] + 1) / (first[r["pair"][0]] + 36)) for r in pairs})


def _share(candidate: Column, characters: str) -> Column:
    """Share of the candidate's characters that match a class."""
    return 1 - F.length(F.regexp_replace(candidate, f"[{characters}]", "")) / F.length(candidate)


def features(found: DataFrame, words: Words) -> DataFrame:
    """``found`` with the columns the forest reads."""
    c, low = F.col("candidate"), F.lower("candidate")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")
    unlikely = -8.0
    if words.pairs:
        table = F.create_map(*[F.lit(x) for p in sorted(words.pairs.items()) for x in p])
        score = lambda i: F.coalesce(F.element_at(table, F.substring(low, i, F.lit(2))), F.lit(unlikely))
        at = F.when(F.length(low) > 1, F.sequence(F.lit(1), F.length(low) - 1)).otherwise(F.array(F.lit(1)))
        pairs = F.aggregate(F.transform(at, score), F.lit(0.0), lambda a, x: a + x) / F.size(at)
    else:
        pairs = F.lit(unlikely)
    if words.dictionary:
        any_word = "|".join(sorted(words.dictionary, key=lambda w: (-len(w), w)))
        covered = 1 - F.length(F.regexp_replace(low, any_word, "")) / F.length(low)
    else:
        covered = F.lit(0.0)
    path, near = F.lower("path"), F.lower("before")
    flag = lambda x: x.cast("double")
    return found.select(
        "*",
        F.length(c).cast("double").alias("length"), _share(c, "0-9").alias("digits"), _share(c, "A-Z").alias("upper"),
        _share(c, "a-z").alias("lower"), _share(c, "^A-Za-z0-9").alias("signs"), _share(c, "0-9a-fA-F").alias("hex"),
        (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) / F.length(c)).alias("runs"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.length(c)).alias("distinct"),
        pairs.alias("pairs"), covered.alias("covered"),
        F.length(path).cast("double").alias("path_length"), flag(path.rlike("test|example|sample|fixture|mock")).alias("path_test"),
        flag(path.rlike(r"\.(env|ini|cfg|conf|py|js|ts|java|go|rb|sh|ya?ml|json|toml)\b")).alias("path_code"),
        F.pmod(F.xxhash64(path), F.lit(16)).cast("double").alias("path_bucket"),
        flag(near.rlike(rf"({_NAMES})\W*$")).alias("named"), flag(near.rlike(rf"{_SIGN}\s*(?:{_QUOTE})?$")).alias("assigned"),
        flag(near.rlike(r"[\"']$") & F.col("after").rlike(rf"^{_QUOTE}")).alias("quoted"),
        flag(near.rlike(r"(sha|md5|hash|digest|checksum|commit|uuid|card|phone|call|id)\W*$")).alias("benign"),
        F.slice(F.split(F.concat_ws(" ", F.reverse(F.regexp_replace(near, r"[^a-z]+", " "))), " +"), 1, 4).alias("_left"),
        F.slice(F.split(F.regexp_replace(F.lower("after"), r"[^a-z]+", " "), " +"), 1, 3).alias("_right"),
    ).withColumn("_near", F.concat(F.transform("_left", lambda w: F.concat(F.lit("<"), w)), F.transform("_right", lambda w: F.concat(F.lit(">"), w))))


def train(labelled: DataFrame, words: Words) -> PipelineModel | None:
    """Forest over ``labelled(path, candidate, before, after, label)``; null without both labels."""
    kinds = {int(r["label"]): r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(kinds) < {0, 1}:
        return None
    # about TRAINING rows at most, as many of either kind as there are, chosen by a hash
    share = F.when(F.col("label") == 1, F.lit(min(1.0, TRAINING / 2 / kinds[1]))).otherwise(min(1.0, TRAINING / 2 / kinds[0]))
    place = F.pmod(F.xxhash64("candidate", "before", "after"), F.lit(1 << 20)) / (1 << 20)
    rows = checkpointed(features(labelled.where(place < share), words).withColumn("label", F.col("label").cast("double")))
    if rows.select("label").distinct().count() < 2:
        return None
    return Pipeline(stages=[
        HashingTF(inputCol="_near", outputCol="_words", numFeatures=NEIGHBOURS, binary=True),
        VectorAssembler(inputCols=[*_FEATURES, "_words"], outputCol="_vector", handleInvalid="keep"),
        RandomForestClassifier(
            featuresCol="_vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="_odds",
            rawPredictionCol="_votes", predictionCol="_said",
        ),
    ]).fit(rows)


def scan(found: DataFrame, words: Words, forest: PipelineModel | None, *ids: str) -> DataFrame:
    """``ids, nth, candidate, before, score, is_secret`` of every candidate; no shuffle."""
    ids = ids or ("doc_id",)
    if forest is None:
        scored = found.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = forest.transform(features(found, words)).withColumn("score", F.get(vector_to_array("_odds"), F.lit(1)))
    return scored.select(*ids, "nth", "candidate", "before", "score", F.coalesce(F.col("score") >= STAYS, F.lit(True)).alias("is_secret"))


def labelled_findings(found: DataFrame) -> DataFrame:
    """Findings that their surroundings label beyond doubt, for tables that come without a reviewer's labels.

    Secret: what is assigned to a credential's name, in quotes with a letter and no white space or template in it, or
    without quotes as 20 or more key-like characters with letters and digits. Not a secret: digits alone, and values
    with a word such as ``example`` in them. All else has no label; standing free in a text says nothing.
    """
    c, near = F.col("candidate"), F.lower("before")
    example = F.lower(c).rlike("example|sample|dummy|xxxx")
    quoted = near.rlike(rf"{_ASSIGNED}{_QUOTE}$") & F.col("after").rlike(rf"^{_QUOTE}") & ~c.rlike(r"[\s${}<>()]")
    bare = near.rlike(rf"{_ASSIGNED}$") & (F.length(c) >= 20) & c.rlike(f"^[{_KEY}]+$") & c.rlike("[0-9]")
    secret = (quoted | bare) & c.rlike("[A-Za-z]") & ~example
    not_one = c.rlike("^[0-9+=_/-]+$") | example
    return found.withColumn("label", F.when(secret, 1).when(not_one, 0)).where("label is not null")


def scanned(docs: DataFrame) -> DataFrame:
    """Candidates of every row of ``docs(doc_id, text, source)`` with the forest's score, trained on what is labelled there."""
    words = words_of(docs)
    found = checkpointed(candidates(docs, "doc_id"))
    return scan(found, words, train(labelled_findings(found), words), "doc_id")
