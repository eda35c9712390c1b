"""Secrets in documents: assigned values and tokens, sorted out by a random forest trained on labelled findings."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearledger.llm.common import running_sums, stored

# Parts of names whose values may be secrets.
NAMES = "token|secret|passw|passphrase|pwd|key|auth|bearer|credential|private"
# What stands before an assigned value: its name, a sign, perhaps a scheme and a quotation mark.
_NAMED = r"[A-Za-z0-9_-]++[\x22\x27\x60]?+\x20*+[:=]++>?+\x20*+(?:(?i:bearer|basic)\x20++)?+"
ASSIGNMENT = rf"^{_NAMED}[\x22\x27\x60]?+(?=.)"
# A value under such a name, whatever it is: all within quotation marks, or else up to a space or mark. The
# look ahead fails at once where no sign follows the name, so a long run of letters is read once.
ASSIGNED = (
    rf"(?<![A-Za-z0-9_-])(?={_NAMED}[^\s])[A-Za-z0-9_-]*?(?i:{NAMES})[A-Za-z0-9_-]*+[\x22\x27\x60]?+\x20*+[:=]++>?+\x20*+"
    r"(?:(?i:bearer|basic)\x20++)?+(?:\x22[^\x22\r\n]++(?=\x22)|\x27[^\x27\r\n]++(?=\x27)|\x60[^\x60\r\n]++(?=\x60)"
    r"|[\x22\x27\x60]?+[^\s\x22\x27\x60,;]++)"
)
# Tokens that hold a letter and a digit; = ends them. Full stops count between other characters.
TOKEN = (
    r"(?<![A-Za-z0-9+/_.~-])(?=[A-Za-z+/_.~-]*+[0-9])(?=[0-9+/_.~-]*+[A-Za-z])"
    r"[A-Za-z0-9+/_~-]++(?:\.++[A-Za-z0-9+/_~-]++)*+={0,2}+"
)
CANDIDATE = f"{ASSIGNED}|{TOKEN}"
THRESHOLD = 0.5
TREES, DEPTH = 30, 6
TRAINED_ON = 6000
# Words that identifiers, paths and placeholders are made of.
DICTIONARY = (
    "about access account active admin agent amount array article author backup based batch block board branch "
    "build button cache canvas category change channel chart check class client cloud code color column comment "
    "common company config content control count country create current customer data date debug default delete "
    "demo design detail device dist document domain download draft dummy edit element email enable entry error "
    "event example export feature field file filter final first folder font form format frame front function "
    "gallery global google graph group guide handle header height hello helper history home host html icon image "
    "import index info input insert install invoice item january july june label large latest layer layout level "
    "library light limit link list local login main manager march master media member menu message method middle "
    "mobile model module month mouse music name network news node note number object office option order owner "
    "package page panel paper param parent part phone photo picture place player plugin point policy position post "
    "preview price private process product profile program project public query random range read record region "
    "release remote report request resource response result return review right root route sample screen script "
    "search section select server service session setting share shop simple single site size small source space "
    "start state static status step store story stream string style submit summer summary support system table "
    "target task team temp template test text theme thumb time title today tool total track type update upload user "
    "value vendor version video view visit volume week white width window winter word world write year"
).split()
# Words beside a token that speak for a secret, and for an identifier or a digest.
SECRET_WORDS = "token|secret|password|passwd|pwd|api[_ -]?key|apikey|access[_ -]?key|auth|bearer|credential|private"
OTHER_WORDS = "commit|sha1|sha256|md5|checksum|digest|hash|uuid|guid|version|revision|build|isbn|doi|id|file|path|page"
FEATURES = (
    "length", "changes", "digits", "uppers", "distinct", "coverage", "slashes", "dots", "extension",
    "in_path", "assigned", "quoted", "secret_word", "other_word",
)
_ROW = "__secret_row"


def found_tokens(text: str) -> Column:
    """Candidates of a text with their start and end (code points) and the words beside them.

    ``left`` is the two words before the value with what stands between, ``right`` the word after it,
    of any length. Only where three candidates stand in one word, ``left`` begins within it.
    """
    both = "transform(m, (x, i) -> CAST(length(get(s, i)) + length(x) AS BIGINT))"
    none = "CAST(array() AS array<struct<start: bigint, end: bigint, found: string, left: string, right: string>>)"
    value = f"regexp_replace(x, r'{ASSIGNMENT}', '')"
    # Read backwards, the words before a place are at the start, where they are found without a search.
    before = (
        "concat(CASE WHEN i > 1 THEN concat(s[i - 2], m[i - 2]) ELSE '' END, CASE WHEN i > 0 THEN concat(s[i - 1], m[i - 1]) "
        "ELSE '' END, s[i], substring(x, 1, length(x) - length(v)))"
    )
    words = r"^[^\p{L}\p{N}]*+\S*+(?:\s[^\p{L}\p{N}]*+\S*+)?+"
    left = f"reverse(regexp_extract(reverse({before}), r'{words}', 0))"
    right = r"regexp_extract(get(s, i + 1), r'^\s*+\S*+', 0)"
    return F.expr(
        f"""transform(array(regexp_extract_all({text}, r'{CANDIDATE}', 0)), m ->
          CASE WHEN size(m) = 0 THEN {none} ELSE transform(
            array(split({text}, r'{CANDIDATE}', -1)), s -> transform(
              array({running_sums(both)}), at -> transform(m, (x, i) -> transform(array({value}), v -> named_struct(
                'start', at[i] + length(s[i]) + length(x) - length(v), 'end', at[i] + length(s[i]) + length(x),
                'found', v, 'left', {left}, 'right', {right}))[0]))[0])[0] END)[0]"""
    )


def features(findings: DataFrame) -> DataFrame:
    """Add the forest's features to ``found, left, right``; NULLs beside a finding count as empty."""
    found = F.col("found")
    low = F.lower(found)
    left, right = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("left", "right"))
    size = F.greatest(F.length(found), F.lit(1))
    kinds = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    known = "(?:" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"

    def has(text: Column, pattern: str) -> Column:
        return text.rlike(pattern).cast("double")

    columns = {
        "length": F.length(found).cast("double"),
        "changes": F.regexp_count(found, F.lit(kinds)) / size,
        "digits": F.regexp_count(found, F.lit("[0-9]")) / size,
        "uppers": F.regexp_count(found, F.lit("[A-Z]")) / size,
        "distinct": F.size(F.array_distinct(F.split(low, ""))) / size,
        "coverage": (F.length(found) - F.length(F.regexp_replace(low, known, ""))) / size,
        "slashes": F.regexp_count(found, F.lit("/")) / size,
        "dots": F.regexp_count(found, F.lit("[.]")) / size,
        "extension": has(low, r"\.(?:png|jpe?g|gif|html?|js|css|py|java|txt|pdf|zip|gz|json|xml|com|org|net)$"),
        "in_path": has(left, r"(?:https?:|www|[/\\@])\S*$") * 1.0,
        "assigned": has(left, r"[=:]\s*[\"'`]?$"),
        "quoted": has(F.concat(F.substring(F.reverse(left), 1, 1), F.substring(right, 1, 1)), "[\"'`]{2}"),
        "secret_word": has(left, rf"(?:{SECRET_WORDS})[^a-z0-9]*(?:\S+[^a-z0-9]+)?$"),
        "other_word": has(left, rf"(?<![a-z])(?:{OTHER_WORDS})[^a-z0-9]*$"),
    }
    return findings.withColumns({name: F.coalesce(c.cast("double"), F.lit(0.0)) for name, c in columns.items()})


def labelled_findings(spark: SparkSession, n: int = TRAINED_ON) -> DataFrame:
    """Findings ``found, left, right, label`` that ``found_tokens`` makes of ``labelled_texts``.

    A finding within the text's stated part has its label; others are no secrets.
    """
    texts = labelled_texts(spark, n)
    found = texts.select("start", "end", "label", F.explode(found_tokens("text")).alias("t"))
    inside = (F.col("t.start") < F.col("end")) & (F.col("t.end") > F.col("start"))
    return found.select("t.found", "t.left", "t.right", F.when(inside, F.col("label")).otherwise(0.0).alias("label"))


def labelled_texts(spark: SparkSession, n: int = TRAINED_ON) -> DataFrame:
    """Short texts with one part of known make, ``text, start, end, label``; in half of them it is a secret.

    Secrets are digests in the alphabets and settings that keys are written in, short passwords and phrases of
    words under a password's name; the rest are commits, checksums, identifiers, paths, versions, numbers and plain
    words under such names. All follow from the row's number.
    """
    h = F.sha2(F.col("id").cast("string"), 256)
    b = F.translate(F.base64(F.unhex(h)), "\n", "")
    word = F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.col("id") % len(DICTIONARY) + 1).cast("int"))
    other = F.element_at(F.array(*map(F.lit, DICTIONARY)), ((F.col("id") * 7 + 3) % len(DICTIONARY) + 1).cast("int"))
    third = F.element_at(F.array(*map(F.lit, DICTIONARY)), ((F.col("id") * 11 + 5) % len(DICTIONARY) + 1).cast("int"))
    digits = F.translate(h, "abcdef", "135792")

    def sub(c: Column, size: int) -> Column:
        return F.substring(c, 1, size)

    secrets = [
        (sub(h, 40), F.concat(word, F.lit(' token = "')), F.lit('" ')),
        (sub(b, 40), F.concat(word, F.lit(" secret_key: '")), F.lit("'")),
        (sub(h, 32), F.concat(word, F.lit(" api_key=")), F.lit(" ")),
        (F.concat(F.lit("AK1A"), F.upper(sub(h, 16))), F.concat(word, F.lit(" access key ")), F.lit(" ")),
        (F.concat(F.lit("gh_"), sub(F.translate(b, "+/=", "xyz"), 36)), F.concat(word, F.lit(" ")), F.lit(" ")),
        (sub(b, 24), F.concat(word, F.lit(' password = "')), F.lit('"')),
        (F.concat(sub(b, 20), F.lit("."), F.substring(b, 21, 20)), F.concat(word, F.lit("_authorization: bearer ")), F.lit(" ")),
        (sub(F.translate(b, "+/=", "abc"), 32), F.concat(word, F.lit(' = "')), F.lit('"')),
        (F.concat(sub(F.translate(b, "+/=", "xyz"), 8), F.lit("&"), sub(digits, 2)), F.concat(word, F.lit(' password = "')), F.lit('"')),
        (F.concat(sub(F.translate(b, "+/=", "xyz"), 9), F.lit("!")), F.concat(word, F.lit("_passwd: ")), F.lit(" ")),
        (F.concat(word, other, third), F.concat(other, F.lit(" password: ")), F.lit(" ")),
        (F.concat(other, third, word, F.lit("s")), F.concat(word, F.lit(' db_password="')), F.lit('"')),
        (F.concat(F.lit("w"), sub(b, 39)), F.concat(F.upper(word), F.lit("_SECRET_KEY=")), F.lit(" ")),
    ]
    others = [
        (sub(h, 40), F.concat(other, F.lit(" commit ")), F.concat(F.lit(" "), word)),
        (h, F.concat(word, F.lit(" sha256: ")), F.lit(" ")),
        (sub(digits, 16), F.concat(word, F.lit(" ")), F.concat(F.lit(" "), other)),
        (
            F.concat_ws("-", sub(h, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)),
            F.concat(word, F.lit(" id ")), F.lit(" "),
        ),
        (F.concat(word, F.lit("/"), other, F.lit("/"), sub(digits, 4), F.lit(".html")), F.concat(third, F.lit(" https://site/")), F.lit(" ")),
        (F.concat(F.lit("//"), other, F.lit("/"), word, F.lit("/"), other, F.lit("/"), sub(digits, 4), F.lit(".html")), F.concat(third, F.lit(" https:")), F.lit(" ")),
        (F.concat(word, F.lit("_"), other, F.lit("_"), sub(digits, 2)), F.concat(other, F.lit(" ")), F.lit(" = ")),
        (F.concat_ws(".", sub(digits, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 2), F.substring(digits, 9, 3)),
         F.concat(word, F.lit(" ")), F.lit(" ")),
        (F.concat(word, F.lit("."), sub(digits, 2), F.lit("-"), other, F.lit(".com")), F.concat(word, F.lit("@")), F.lit(" ")),
        (word, F.concat(third, F.lit(" password: ")), F.concat(F.lit(" "), other)),
        (word, F.concat(third, F.lit(' token = "')), F.lit('"')),
        (F.concat(word, F.lit(" "), other), F.concat(third, F.lit(' api_key: "')), F.lit('"')),
        (F.concat(word, F.lit("."), other), F.concat(third, F.lit(" auth = ")), F.lit(" ")),
        (F.concat(F.substring(word, 1, 1), sub(digits, 2)), F.concat(other, F.lit(" ")), F.concat(F.lit(" "), word)),
        (F.concat(F.substring(word, 1, 1), sub(digits, 1), F.substring(other, 1, 1)), F.concat(third, F.lit(" token ")), F.concat(F.lit(" "), word)),
    ]

    def pick(makers: list, part: int) -> Column:
        kind = F.floor(F.col("id") / 2) % len(makers)
        choice = F.when(kind == 0, makers[0][part])
        for i, maker in enumerate(makers[1:], 1):
            choice = choice.when(kind == i, maker[part])
        return choice

    is_secret = F.col("id") % 2 == 0
    columns = [
        F.when(is_secret, pick(secrets, p)).otherwise(pick(others, p)).alias(name)
        for p, name in enumerate(("found", "left", "right"))
    ]
    parts = spark.range(n).select(*columns, is_secret.cast("double").alias("label"))
    start = F.length("left")
    return parts.select(
        F.concat("left", "found", "right").alias("text"), start.alias("start"),
        (start + F.length("found")).alias("end"), "label",
    )


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> RandomForestClassificationModel:
    """A forest from labelled findings; the model is a few hundred nodes whatever their number."""
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(findings))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")
    return forest.fit(vectors.where("label IS NOT NULL").select("features", "label"))


def scored(findings: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Add ``score``, the forest's probability that a finding is a secret."""
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="__vector").transform(features(findings))
    model = model.copy().setFeaturesCol("__vector").setProbabilityCol("__probability")
    rated = model.setRawPredictionCol("").setPredictionCol("").transform(vectors)
    return rated.withColumn("score", vector_to_array("__probability")[1]).drop(*FEATURES, "__vector", "__probability")


def secret_scan(
    docs: DataFrame, model: RandomForestClassificationModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_candidates, secrets`` per row; secrets are structs of start, end and score, in order.

    Candidates are found in whole texts, which are read once; the forest removes the
    false positives. A NULL or empty text has none. Repeated rows are scanned
    each. An empty table gives no rows. Columns besides the two named are not read.
    """
    body = "__secret_text"
    rows = docs.select(
        F.col(f"`{key}`").alias("doc_id"), F.monotonically_increasing_id().alias(_ROW),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(body),
    )
    rows = stored(rows.select("doc_id", _ROW, found_tokens(body).alias("tokens")), "secrets")
    single = rows.select(_ROW, F.explode("tokens").alias("t")).select(_ROW, "t.*")
    kept = scored(single, model).where(F.col("score") >= THRESHOLD)
    spans = kept.groupBy(_ROW).agg(F.array_sort(F.collect_list(F.struct("start", "end", "score"))).alias("secrets"))
    none = F.array().cast("array<struct<start: bigint, end: bigint, score: double>>")
    return rows.join(spans, _ROW, "left").select(
        "doc_id", F.size("tokens").alias("n_candidates"), F.coalesce("secrets", none).alias("secrets")
    )
