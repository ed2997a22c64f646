"""Secret scans: a wide net of candidates, and a random forest that takes the false alarms out.

A candidate is a run of 16 or more characters of a key alphabet with a digit in it, a quoted value of 8 to 64
characters, or a private key from its head to its end line. The forest sees its length and alphabet, how often the
kind of character changes along it, how much of it the words of the corpus cover, where the document comes from, and
the words next to it. It is trained from labelled findings, given or made by rules where there are none, on a bounded
sample of them; the corpus words are counted over all documents. Everything is DataFrame functions and Spark's own
forest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlens.llm import bitfilter
from meterlens.llm.tables import hex_digest
from meterlens.session import cut

NO_ID = -(2**63)
MARK = "[secret]"
#: Characters of text kept on each side of a candidate.
BEFORE, AFTER = 48, 24
#: A word is in the dictionary if it stands outside candidates in so many distinct texts: a share of all, at least two
#: once there are ``FEW_TEXTS``, and one below.
KNOWN_SHARE, FEW_TEXTS = 1e-4, 50
CANDIDATE = (
    r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}+"
    r"""|(?<=["'])[^"'\s]{8,64}+(?=["'])"""
    r"|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
)
#: No candidate is shorter.
SHORTEST = 8
_KEY = r"(?i)(token|secret|passw|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private)"
#: As words of their own, not as parts of hosts or names.
_BENIGN = (
    r"(?i)(?<![\w@./-])(example|sample|dummy|placeholder|changeme|commit|checksum|sha-?\d+|md5|digest|uuid|isbn|version)"
    r"(?![\w@./-])"
)
_PROVIDER = r"^(AKIA[0-9A-Z]{16}$|gh[pousr]_|xox[abprs]-|sk-|AIza|eyJ|-----BEGIN)"
FEATURES = (
    "length digits upper lower marks changes vowels distinct entropy hex numeric covered "
    "path_depth path_test near_key any_key assigned quoted benign provider"
).split()


@dataclass(frozen=True)
class ScanParams:
    #: Most labelled findings in the fit: of each kind those with the smallest hashes, half of them if both have that many.
    max_labelled: int = 20_000
    trees: int = 40
    depth: int = 8
    threshold: float = 0.5
    seed: int = 7


@dataclass(frozen=True)
class ScanModel:
    """A forest, or none where one class is missing among the labelled findings."""

    forest: RandomForestClassificationModel | None


def _rows(documents: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.col(path_col).cast("string") if path_col in documents.columns else F.lit(None).cast("string")
    return documents.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("th"),
        text.alias("text"),
        F.coalesce(path, F.lit("")).alias("path"),
    )


def candidates(rows: DataFrame) -> DataFrame:
    """(id, th, pos, start, value, before, after, path): every candidate of every text.

    ``before`` and ``after`` are the text on each side, other candidates included.
    ``start`` counts code points. Rows of one id and text are searched once.
    """
    found = (
        rows.where(F.col("text").rlike(CANDIDATE))
        .withColumn("hits", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
        .withColumn("gaps", F.split("text", CANDIDATE, -1))
        .drop("text")
    )
    # The text on each side, put together again from so many neighbours that they reach over BEFORE and AFTER.
    at = lambda column, i: F.coalesce(F.get(column, i), F.lit(""))
    ends = lambda column, i: F.right(at(column, i), F.lit(BEFORE))
    starts = lambda column, i: F.left(at(column, i), F.lit(AFTER))
    left = lambda i: [ends(c, i - k) for k in range(BEFORE // SHORTEST, 0, -1) for c in ("gaps", "hits")]
    right = lambda i: [starts(c, i + k) for k in range(1, AFTER // SHORTEST + 1) for c in ("gaps", "hits")]
    hit = lambda v, i: F.struct(
        i.alias("pos"),
        v.alias("value"),
        F.char_length(at("gaps", i)).alias("gap"),
        F.right(F.concat(*left(i), ends("gaps", i)), F.lit(BEFORE)).alias("before"),
        F.left(F.concat(*right(i)), F.lit(AFTER)).alias("after"),
    )
    each = found.select("id", "th", "path", F.explode(F.transform("hits", hit)).alias("hit")).select(
        "id", "th", "path", "hit.*"
    )
    along = Window.partitionBy("id", "th").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    passed = F.sum(F.col("gap") + F.char_length("value")).over(along)
    return (
        each.groupBy("id", "th", "pos")
        .agg(*[F.min(c).alias(c) for c in ("path", "value", "gap", "before", "after")])
        .withColumn("start", (passed - F.char_length("value")).cast("int"))
        .drop("gap")
    )


def coverage(found: DataFrame, rows: DataFrame, max_filter_bytes: int = bitfilter.MAX_FILTER_BYTES) -> DataFrame:
    """(id, th, pos, letters): letters of a candidate that are words of the dictionary.

    The dictionary holds words that stand outside any candidate in enough distinct texts, so a secret does not cover
    itself however often it is repeated. Words that stand in no candidate are dropped by a bounded filter before
    anything is counted.
    """
    texts = rows.select("th").distinct().count()
    least = max(1 if texts < FEW_TEXTS else 2, math.ceil(texts * KNOWN_SHARE))
    runs = cut(
        found.select("id", "th", "pos", F.explode(F.expr("regexp_extract_all(lower(value), '[a-z]{3,}', 0)")).alias("w"))
        .withColumn("h", F.xxhash64("w"))
    )
    asked = runs.select("h").distinct()
    cells = bitfilter.cells_for(asked.count(), max_filter_bytes)
    plain = F.lower(F.regexp_replace("text", CANDIDATE, " "))
    words = rows.select("th", F.explode(F.array_distinct(F.split(plain, r"[^a-z]++"))).alias("w")).where(
        F.char_length("w") >= 3
    )
    maybe = bitfilter.ask(
        words.withColumn("h", F.xxhash64("w")), "h", bitfilter.build(asked, "h", cells, least=1), cells, "maybe"
    )
    once = maybe.where("maybe").select("w", "th").distinct()
    known = once.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return (
        runs.join(known.select("w"), "w").groupBy("id", "th", "pos").agg(F.sum(F.char_length("w")).alias("letters"))
    )


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.char_length("value")


def with_features(found: DataFrame, covered: DataFrame) -> DataFrame:
    """Candidates with the columns of ``FEATURES``, all doubles."""
    n = F.char_length("value")
    chars = F.split("value", "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    # Kinds change where a character is followed by one of another kind.
    change = r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])"
    flag = lambda c, pattern: F.when(F.col(c).rlike(pattern), 1.0).otherwise(0.0)
    made = {
        "length": F.log2(n.cast("double")),
        "digits": _share("[0-9]"),
        "upper": _share("[A-Z]"),
        "lower": _share("[a-z]"),
        "marks": _share("[^A-Za-z0-9]"),
        "changes": _share(change),
        "vowels": _share("[aeiouAEIOU]"),
        "distinct": F.size(F.array_distinct(chars)) / n,
        "entropy": F.aggregate(
            F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))
        ),
        "hex": flag("value", r"^([0-9a-f]+|[0-9A-F]+)$"),
        "numeric": flag("value", r"^[0-9_+/=-]+$"),
        "covered": F.coalesce(F.col("letters"), F.lit(0)) / n,
        "path_depth": F.size(F.split("path", "/")).cast("double"),
        "path_test": flag("path", r"(?i)(test|example|sample|fixture|mock|docs?/)"),
        "near_key": flag("before", _KEY + r"[^\s]{0,12}\s*[=:(]*\s*[\"']?$"),
        "any_key": flag("before", _KEY),
        "assigned": flag("before", r"[=:]\s*[\"']?$"),
        "quoted": flag("before", r"[\"']$"),
        "benign": F.when(F.col("before").rlike(_BENIGN) | F.col("after").rlike(_BENIGN), 1.0).otherwise(0.0),
        "provider": flag("value", _PROVIDER),
    }
    return found.join(covered, ["id", "th", "pos"], "left").withColumns({k: v.cast("double") for k, v in made.items()})


def rule_labels(features: DataFrame) -> DataFrame:
    """(id, th, pos, label): labelled findings where none are given.

    1 for provider formats and for random values assigned to a key's name; 0 for numbers, ordinary words and values
    that stand beside words such as "example" or "checksum"; the others get no label.
    """
    random = (F.col("entropy") >= 3.0) & (F.col("digits") > 0) & (F.col("covered") < 0.3) & (F.col("numeric") == 0)
    good = ((F.col("provider") == 1) | ((F.col("near_key") == 1) & (F.col("assigned") == 1) & random)) & (
        F.col("benign") == 0
    )
    bad = (F.col("numeric") == 1) | (F.col("covered") >= 0.6) | ((F.col("benign") == 1) & (F.col("provider") == 0))
    return features.select("id", "th", "pos", F.when(good, 1).when(bad, 0).alias("label")).where("label is not null")


def _vectors(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="vector", handleInvalid="keep").transform(features)


def train(features: DataFrame, labels: DataFrame, params: ScanParams = ScanParams()) -> ScanModel:
    """Fits the forest on (id, th, pos, label); at most ``max_labelled`` findings, in an order of their own.

    The sample is drawn for each class, so the rarer one is in it whatever its share of the findings; what one class
    leaves of its half goes to the other.
    """
    known = cut(
        features.join(labels, ["id", "th", "pos"])
        .where(F.col("label").isin(0, 1))
        .select(F.xxhash64("id", "th", "pos").alias("h"), F.col("label").cast("double"), *FEATURES)
    )
    counts = {int(r["label"]): r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return ScanModel(None)
    half = params.max_labelled // 2
    first = lambda c: known.where(F.col("label") == c).orderBy("h", *FEATURES).limit(
        params.max_labelled - min(counts[1 - c], half)
    )
    sample = cut(first(0).unionByName(first(1)))
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=params.trees, maxDepth=params.depth, seed=params.seed
    )
    return ScanModel(forest.fit(_vectors(sample.orderBy("h", *FEATURES).coalesce(1))))


def judge(
    features: DataFrame, model: ScanModel, params: ScanParams = ScanParams(), labels: DataFrame | None = None
) -> DataFrame:
    """(id, th, pos, start, value, score, is_secret).

    Without a forest the score is the finding's own label: the given one (id, th, pos, label), else that of the rules,
    else 0.
    """
    if model.forest is None:
        marks = rule_labels(features).withColumnRenamed("label", "by_rule")
        scored = features.join(marks, ["id", "th", "pos"], "left")
        if labels is not None:
            scored = scored.join(labels, ["id", "th", "pos"], "left")
        given = F.lit(None) if labels is None else F.col("label")
        scored = scored.withColumn("score", F.coalesce(given, F.col("by_rule"), F.lit(0)).cast("double"))
    else:
        scored = model.forest.transform(_vectors(features)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        "id", "th", "pos", "start", "value", "score", (F.col("score") >= params.threshold).alias("is_secret")
    )


def _judged(
    documents: DataFrame, id_col: str, text_col: str, path_col: str | None, params: ScanParams, labels: DataFrame | None
) -> DataFrame:
    rows = _rows(documents, id_col, text_col, path_col)
    found = cut(candidates(rows))
    features = cut(with_features(found, coverage(found, rows)))
    if labels is None:
        marks = rule_labels(features)
    else:
        given = labels.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("start"), F.col("label").cast("int")
        ).where("label is not null")
        marks = (
            features.join(given.groupBy("id", "start").agg(F.min("label").alias("label")), ["id", "start"])
            .select("id", "th", "pos", "label")
        )
    return judge(features, train(features, marks, params), params, marks)


def findings(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
    params: ScanParams = ScanParams(),
    labels: DataFrame | None = None,
) -> DataFrame:
    """doc_id, start, length, value_sha256, score, is_secret of every candidate, false alarms too.

    ``labels`` (doc_id, start, label) are findings judged by people; without them rules label what they are sure of.
    Null and empty texts have no candidates. Rows that share doc_id and text are reported once; a null doc_id stays
    null. A missing or null path is empty. An empty table gives an empty result.
    """
    return _judged(documents, id_col, text_col, path_col, params, labels).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "start",
        F.char_length("value").alias("length"),
        hex_digest(F.col("value")).alias("value_sha256"),
        "score",
        "is_secret",
    )


def redact(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
    params: ScanParams = ScanParams(),
    labels: DataFrame | None = None,
) -> DataFrame:
    """All rows and columns of ``documents``; in the texts each secret is replaced by ``MARK``.

    Where there is a column n_chars, changed rows get the new text's number of code points. Only documents that may
    hold a secret are shuffled, told by a bounded filter; the rest pass straight through.
    """
    columns = documents.columns
    secrets = cut(
        _judged(documents, id_col, text_col, path_col, params, labels)
        .where("is_secret")
        .groupBy("id", "th")
        .agg(F.sort_array(F.collect_list(F.struct("start", F.char_length("value").alias("length")))).alias("spans"))
    )
    rows = documents.select(
        F.struct("*").alias("__row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
    )
    hashes = secrets.select("th").distinct()
    cells = bitfilter.cells_for(hashes.count())
    asked = bitfilter.ask(rows, "th", bitfilter.build(hashes, "th", cells, least=1), cells, "__maybe")
    text = F.col(f"__row.`{text_col}`")
    piece = lambda a, b: F.substr(text, a + 1, b - a)
    cleaned = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            (s["start"] + s["length"]).cast("int").alias("at"),
            F.concat(acc["out"], piece(acc["at"], s["start"]), F.lit(MARK)).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.char_length(text))),
    )
    touched = (
        asked.where("__maybe")
        .join(secrets, ["id", "th"], "left")
        .withColumn("__new", F.when(F.col("spans").isNull(), text).otherwise(cleaned))
    )
    made = []
    for c in columns:
        old = F.col(f"__row.`{c}`")
        if c == text_col:
            old = F.col("__new")
        elif c == "n_chars":
            kind = documents.schema[c].dataType
            old = F.when(F.col("spans").isNull(), old).otherwise(F.char_length("__new").cast(kind))
        made.append(old.alias(c))
    plain = asked.where("not __maybe").select(*[F.col(f"__row.`{c}`").alias(c) for c in columns])
    return touched.select(*made).unionByName(plain)
