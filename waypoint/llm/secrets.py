"""Secret scans: candidates by pattern, false positives removed by a random forest trained from labelled findings."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waypoint.llm.common import stored

#: Runs of at least 16 such characters with a digit among the first 65 are candidates.
RUN = "[A-Za-z0-9+/_=-]"
#: Each match starts where the last ended, so a text without candidates is read once.
SCAN = rf"(?s)\G.*?(?={RUN[:-1].replace('0-9', '')}]{{0,64}}[0-9]){RUN}{{16,}}"
CREDENTIAL = "(?i)(token|secret|passw|pwd|api.?key|auth|bearer|credential|private.?key|access.?key)[^\\n]{0,24}$"
HARMLESS = "(?i)(sha-?1|sha-?256|md5|commit|checksum|hash|digest|uuid|guid|revision|version|build|order|invoice|isbn|id)[^\\n]{0,12}$"
PATH = r"([\\/]|https?:|\.[a-z]{2,4}/|[?&]\w*=)\S*$"
FEATURES = [
    "length", "digit_share", "upper_share", "hex", "turns", "case_turns", "variety", "coverage", "path", "slashes", "credential", "harmless", "assigned", "quoted",
]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, candidate, before, after) of each candidate; start counts code points from 0, contexts are short."""
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = own.select(
        "id", F.xxhash64("text").alias("hash"), F.col("text"), F.regexp_extract_all("text", F.lit(SCAN), F.lit(0)).alias("pieces")
    ).where(F.size("pieces") > 0)
    # after a candidate comes the head of the next piece, after the last one the rest of the text
    used = F.aggregate("pieces", F.lit(0), lambda n, p: n + F.char_length(p))
    heads = F.concat(F.transform(F.slice("pieces", F.lit(2), F.size("pieces")), lambda p: F.left(p, F.lit(12))), F.array(F.substring("text", used + 1, F.lit(12))))
    rows = pieces.select("id", "hash", F.posexplode(F.arrays_zip("pieces", heads.alias("heads"))).alias("k", "z")).select(
        "id", "hash", "k", F.col("z.pieces").alias("piece"), F.col("z.heads").alias("after")
    )
    cut = rows.withColumn("candidate", F.regexp_extract("piece", f"{RUN}+$", 0)).withColumn("size", F.char_length("piece"))
    cut = cut.withColumn("before", F.right(F.left("piece", F.col("size") - F.char_length("candidate")), F.lit(80))).drop("piece")
    so_far = Window.partitionBy("id", "hash").orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # rows repeated with the same id and text have the same pieces; each counts its own share
    copies = Window.partitionBy("id", "hash", "k")
    placed = cut.withColumn("start", (F.sum(F.col("size")).over(so_far) / F.count("*").over(copies)).cast("long") - F.char_length("candidate"))
    return placed.select("id", "start", "candidate", "before", "after")


def common_words(docs: DataFrame, size: int = 2000, text_col: str = "text") -> list[str]:
    """The most frequent words of three letters and more of the whole corpus; at most ``size`` of them reach the driver."""
    words = docs.select(F.explode(F.split(F.lower(text_col), "[^a-z]+")).alias("w")).where(F.char_length("w") >= 3)
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(size)
    return [r[0] for r in top.collect()]


def _share(of: Column, without: Column) -> Column:
    return (F.char_length(of) - F.char_length(without)) / F.char_length(of)


def with_features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """Length, kinds of characters and turns between them, dictionary coverage, path and neighbouring words."""
    c, before = F.col("candidate"), F.col("before")
    turns = F.regexp_count(c, F.lit("(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])"))
    cases = F.regexp_count(c, F.lit("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"))
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))
    known = F.filter(words, lambda w: w.isin(dictionary or [""]))
    n = F.char_length(c)
    return found.withColumns(
        {
            "length": n.cast("double"),
            "digit_share": _share(c, F.translate(c, "0123456789", "")),
            "upper_share": _share(c, F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
            "hex": c.rlike("^[0-9a-fA-F]+$").cast("double"),
            "turns": turns / n,
            "case_turns": cases / n,
            "variety": F.size(F.array_distinct(F.split(F.left(c, F.lit(256)), ""))) / F.least(n, F.lit(256)),
            "coverage": F.aggregate(known, F.lit(0), lambda s, w: s + F.char_length(w)) / n,
            "slashes": F.regexp_count(c, F.lit("/")).cast("double"),
            "path": before.rlike(PATH).cast("double"),
            "credential": before.rlike(CREDENTIAL).cast("double"),
            "harmless": before.rlike(HARMLESS).cast("double"),
            "assigned": before.rlike("[=:]\\s*[\"']?$").cast("double"),
            "quoted": (before.rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        }
    )


#: Contexts of made findings: what stands before, after, and whether it is a secret.
CONTEXTS = [
    ('token = "', '"', 1), ("password: ", "\n", 1), ("api_key='", "'", 1), ("Authorization: Bearer ", " ", 1), ("SECRET=", "\n", 1), ('"access_key": "', '",', 1),
    ("commit ", "\n", 0), ("sha256: ", "\n", 0), ("https://host.org/files/", "/x", 0), ('checksum = "', '"', 0), ("uuid: ", " ", 0), ("see /var/data/", ".txt", 0), ("order ", " and", 0),
]


def made_findings(spark: SparkSession, n: int = 300, offset: int = 0) -> DataFrame:
    """Labelled findings made from hashes: random hexadecimal, base64 and mixed strings, and long names and numbers, in each context."""
    h = F.sha2(F.concat(F.lit("finding-"), F.col("id").cast("string")).cast("binary"), 256)
    numbers = F.translate(h, "abcdef", "012345")
    name = F.concat(F.lit("report-of-the-year-"), F.substring(numbers, 1, 4), F.lit("-and-other-notes"))
    values = F.array(
        F.struct(F.substring(h, 1, 40).alias("c"), F.lit(1).alias("random")),
        F.struct(F.translate(F.base64(F.unhex(F.substring(h, 1, 48))), "\n", "").alias("c"), F.lit(1).alias("random")),
        F.struct(F.concat(F.upper(F.substring(h, 1, 6)), F.substring(F.base64(F.unhex(h)), 1, 20)).alias("c"), F.lit(1).alias("random")),
        F.struct(name.alias("c"), F.lit(0).alias("random")),
        F.struct(F.substring(numbers, 1, 20).alias("c"), F.lit(0).alias("random")),
    )
    contexts = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(a).alias("after"), F.lit(y).alias("y")) for b, a, y in CONTEXTS])
    rows = spark.range(offset, offset + n).select("id", F.posexplode(values).alias("i", "v"), contexts.alias("all"))
    rows = rows.select("id", "i", "v", F.posexplode("all").alias("j", "x"))
    texts = rows.select(
        (F.col("id") * 1000 + F.col("i") * 100 + F.col("j")).alias("id"),
        F.concat(F.lit("and so "), F.col("x.before"), F.col("v.c"), F.col("x.after"), F.lit(" on")).alias("text"),
        (F.col("v.random") * F.col("x.y")).cast("double").alias("label"),
    )
    # found in their texts as all others are: a path may be part of a candidate
    return candidates(texts, "id").join(texts.select("id", "label"), "id").select("candidate", "before", "after", "label")


def sampled_findings(found: DataFrame, limit: int = 2000) -> DataFrame:
    """A bounded sample of the corpus' own candidates, by hash: assigned to a credential, or else not, as labels."""
    label = F.col("before").rlike(CREDENTIAL) & F.col("before").rlike("[=:]\\s*[\"']?$")
    rows = found.select("candidate", "before", "after", label.cast("double").alias("label"), F.xxhash64("id", "start", "candidate").alias("h"))
    return rows.orderBy("h", "candidate", "before").limit(limit).drop("h")


def train(labelled: DataFrame, dictionary: list[str], trees: int = 30, depth: int = 6, seed: int = 7) -> RandomForestClassificationModel:
    """Fit on labelled findings (candidate, before, after, label), a bounded set, in one ordered partition, so that the forest is the same each time."""
    rows = with_features(labelled, dictionary).select(*FEATURES, "label").repartition(1).sortWithinPartitions(*FEATURES, "label")
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(data)


def score(found: DataFrame, model: RandomForestClassificationModel, dictionary: list[str], threshold: float = 0.5) -> DataFrame:
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(found, dictionary))
    out = model.transform(data).withColumn("probability", vector_to_array("probability")[1])
    return out.select("id", "start", "candidate", "before", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(id, start, candidate, before, probability, is_secret) of every candidate.

    ``labelled`` are findings with columns candidate, before, after and label; without them 19,500 made
    ones are taken, and up to 2,000 of the corpus labelled by what stands before them.

    Defined cases: null and empty texts have no candidates; a null id is a value of its own; repeated
    rows report each of their candidates; texts of any length are read once; an empty table gives an
    empty table; other columns are not read.
    """
    found = stored(candidates(docs), "candidates")
    dictionary = common_words(docs)
    if labelled is None:
        labelled = made_findings(docs.sparkSession).unionByName(sampled_findings(found))
    return score(found, train(labelled, dictionary), dictionary, threshold)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_chars, sha256 of the candidate, probability (four digits) and is_secret: no secret is repeated."""
    return scan(docs).select(
        F.col("id").alias("doc_id"),
        "start",
        F.char_length("candidate").cast("long").alias("n_chars"),
        F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"),
        F.round("probability", 4).alias("probability"),
        "is_secret",
    )
