"""Personal data: fixed patterns, and identifiers found by the contexts that known ones stand in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearledger.llm.common import running_sums, stored

# The kinds in the order in which spans that begin together are listed.
KINDS = ("email", "ip", "card", "phone")
# The same matches as the plain patterns give. Runs are possessive and begin at their first
# character, so that neither time nor the depth of the matcher grows with a long run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be worth trying.
HINTS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9]",
}
# Tokens that look like identifiers: something around an @, letters with digits, or digits, with the usual separators.
CANDIDATE = (
    r"(?<![^\x20\x09-\x0D@])[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++"
    r"|(?<![A-Za-z0-9/.-])(?=[0-9/.-]*+[A-Za-z])(?=[A-Za-z/.-]*+[0-9])[A-Za-z0-9]++(?:[/.-]++[A-Za-z0-9]++)*+"
    r"|(?<![A-Za-z0-9])[+(]{0,2}[0-9][0-9().\x20/-]*[0-9](?![A-Za-z0-9])"
)
# Contexts and instances longer than this stand in the graph by their digest.
NAMED = 256
# Rounds over the graph for each set of seeds, and what a pattern needs to find identifiers of its own.
ROUNDS = 2
MIN_SEEDS, MIN_CONFIDENCE, MIN_SCORE = 3, 0.8, 0.5
# Words next to a place. Those before it are read backwards, where they come first and need no search.
_WORD = r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]*+"
_TWO_WORDS = r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]*+(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)?+"
_ROW, _TEXT, _BASE, _NEAR = "__pii_row", "__pii_text", "__pii_base", "__pii_near"


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the Luhn check."""
    n = f"length({digits})"
    at = f"CAST(substring({digits}, {n} - i, 1) AS INT)"
    doubled = f"CASE WHEN i % 2 = 1 THEN 2 * {at} - CASE WHEN {at} > 4 THEN 9 ELSE 0 END ELSE {at} END"
    return f"aggregate(transform(sequence(0, {n} - 1), i -> {doubled}), 0, (a, x) -> a + x) % 10 = 0"


def _valid(kind: str) -> str:
    """SQL: whether a match ``x.found`` counts."""
    digits = "regexp_replace(x.found, '[^0-9]', '')"
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return {
        "email": "true",
        "ip": rf"x.found RLIKE r'^{part}(?:\.{part}){{3}}$'",
        "card": f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {_luhn(digits)} ELSE false END",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
    }[kind]


def located(text: str, pattern: str, hint: str, beside: str = "") -> str:
    """SQL: the matches of a pattern as structs of start, end (code points), the match and further fields.

    The texts between the matches come from a split by the same pattern; the
    lengths of both add up to the positions. ``beside`` makes further fields of the matches ``m``, the
    texts ``s`` between them and the place ``i`` of a match.
    """
    both = "transform(m, (x, i) -> CAST(length(get(s, i)) + length(x) AS BIGINT))"
    fields = f", {beside}" if beside else ""
    return f"""
    transform(array(CASE WHEN {text} RLIKE r'{hint}' THEN regexp_extract_all({text}, r'{pattern}', 0)
                    ELSE CAST(array() AS array<string>) END), m -> transform(
      array(CASE WHEN size(m) = 0 THEN CAST(array() AS array<string>) ELSE split({text}, r'{pattern}', -1) END),
      s -> transform(array({running_sums(both)}), at -> transform(m, (x, i) -> named_struct(
          'start', at[i] + length(s[i]), 'end', at[i] + length(s[i]) + length(x), 'found', x{fields})))[0])[0])[0]
    """


def base_spans(text: str) -> Column:
    """Spans ``start, kind (its place in KINDS), end`` of the fixed patterns, in order."""
    kinds = []
    for k, kind in enumerate(KINDS):
        found = f"filter({located(text, PATTERNS[kind], HINTS[kind])}, x -> {_valid(kind)})"
        kinds.append(f"transform({found}, x -> named_struct('start', x.start, 'kind', {k}, 'end', x.end))")
    return F.expr(f"array_sort(concat({', '.join(kinds)}))")


def candidates(text: str) -> Column:
    """Identifier-like tokens of any length with their place, folded form and the words around them.

    The fold keeps letters and digits in lower case. Contexts are the two words
    before the token, and the word before with the word after it, whole words of any length; digits in them count
    alike. A neighbouring token counts as a word. Only where three tokens follow each other, the words before the
    last begin with the first of the two tokens before it.
    """
    back = (
        "reverse(concat(CASE WHEN i > 1 THEN m[i - 2] ELSE '' END, CASE WHEN i > 0 THEN concat(s[i - 1], m[i - 1]) "
        "ELSE '' END, s[i]))"
    )
    ahead = "concat(get(s, i + 1), coalesce(get(m, i + 1), ''), coalesce(get(s, i + 2), ''))"
    beside = (
        f"'two', reverse(regexp_extract({back}, r'{_TWO_WORDS}', 0)), "
        f"'one', reverse(regexp_extract({back}, r'{_WORD}', 0)), 'next', regexp_extract({ahead}, r'{_WORD}', 0)"
    )
    before, word, after = (
        f"regexp_replace(trim(BOTH ' \\t\\n\\r' FROM lower(x.{c})), '[0-9]+', '0')" for c in ("two", "one", "next")
    )
    named = "CASE WHEN length({0}) > " + str(NAMED) + " THEN sha2({0}, 256) ELSE {0} END"
    folded = "regexp_replace(lower(x.found), '[^a-z0-9@]', '')"
    return F.expr(
        f"""transform({located(text, CANDIDATE, '[0-9@]', beside)}, x -> named_struct(
            'start', x.start, 'end', x.end, 'kind', CASE WHEN contains(x.found, '@') THEN 0 ELSE 1 END,
            'instance', {named.format(folded)},
            'contexts', transform(filter(array(concat('l ', {before}), concat('b ', {word}, ' _ ', {after})),
                               c -> NOT c RLIKE r'^(l |b  _)' OR length(c) > 4), c -> {named.format('c')})))"""
    )


def _occurrences(rows: DataFrame) -> DataFrame:
    """One row per candidate; ``seed`` is the kind of the first base span it overlaps, if any."""
    near = rows.select(_ROW, _BASE, F.explode(_NEAR).alias("c"))
    seed = F.expr(f"get(filter({_BASE}, b -> b.start < c.end AND c.start < b.end), 0).kind")
    return near.select(
        _ROW, F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.instance").alias("instance"),
        F.col("c.kind").alias("look"), F.col("c.contexts").alias("contexts"), seed.alias("seed"),
    )


def bootstrap(occurrences: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Score the graph of contexts and instances: ``context, kind, confidence`` of the
    patterns accepted, and ``instance, kind, score``.

    Each pair of a context and an instance is one edge, however often it
    occurs. An instance that the fixed patterns know has score 1 for its kind. In each
    round a context's confidence is the mean score of its instances, less one unseen
    instance, and an unknown instance's score the mean confidence of its contexts. After ``rounds``
    rounds the instances that accepted patterns find become seeds like the known ones, and the rounds
    begin anew, until none is added. More rounds without new seeds would only spread the scores of the
    same few seeds over all instances of a context. Every step is an aggregate over edges and is
    written, so the graph never leaves the executors.
    """
    edges = stored(
        occurrences.select(F.explode("contexts").alias("context"), "instance", "seed", "look")
        .groupBy("context", "instance").agg(F.min("seed").alias("seed"), F.min("look").alias("look")),
        "pii-edges",
    )
    seeds = edges.where("seed IS NOT NULL").groupBy("instance", F.col("seed").alias("kind")).agg(
        F.lit(1.0).alias("score")
    )
    sizes = edges.groupBy("context").agg(F.count(F.lit(1)).alias("n"))
    degrees = edges.groupBy("instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    degrees = degrees.where("seed IS NULL").drop("seed")
    unknown = edges.where("seed IS NULL").select("context", "instance", "look")
    accepted = None
    while True:
        scores = stored(seeds, "pii-scores")
        patterns = scores.select(F.lit("").alias("context"), "kind", F.col("score").alias("confidence")).limit(0)
        for _ in range(rounds):
            patterns = stored(
                edges.select("context", "instance").join(scores, "instance").groupBy("context", "kind")
                .agg(F.sum("score").alias("sum"), F.count_if(F.col("score") == 1.0).alias("seeds"))
                .join(sizes, "context")
                .select("context", "kind", "seeds", (F.col("sum") / (F.col("n") + 1)).alias("confidence")),
                "pii-patterns",
            )
            found = (
                unknown.join(patterns, "context")
                .groupBy("instance", "kind").agg(F.sum("confidence").alias("sum"))
                .join(degrees, "instance")
                .select("instance", "kind", (F.col("sum") / F.col("n")).alias("score"))
            )
            scores = stored(seeds.unionByName(found), "pii-scores")
        fit = patterns.where(f"seeds >= {MIN_SEEDS} AND confidence >= {MIN_CONFIDENCE}").drop("seeds")
        if accepted is not None:
            fit = fit.unionByName(accepted).groupBy("context", "kind").agg(F.max("confidence").alias("confidence"))
        accepted = stored(fit, "pii-accepted")
        added = stored(
            unknown.join(accepted, "context").where(_fits())
            .join(scores.where(f"score >= {MIN_SCORE}"), ["instance", "kind"])
            .groupBy("instance").agg(F.min(F.struct(-F.col("score"), "kind")).getField("kind").alias("kind"))
            .withColumn("score", F.lit(1.0)),
            "pii-added",
        )
        if added.isEmpty():
            return accepted, scores
        seeds = stored(seeds.unionByName(added), "pii-seeds")
        unknown = stored(unknown.join(added, "instance", "left_anti"), "pii-unknown")
        degrees = stored(degrees.join(added, "instance", "left_anti"), "pii-degrees")


def _fits() -> Column:
    return (F.col("look") == 0) == (F.col("kind") == 0)


def discovered(rows: DataFrame) -> DataFrame:
    """Spans ``start, kind, end`` per row that accepted patterns find beside the fixed ones.

    The instance must be scored for the kind as well, and look like it: an
    address has an @, any other identifier has none.
    """
    seen = _occurrences(rows)
    patterns, scores = bootstrap(seen)
    found = (
        seen.where("seed IS NULL")
        .select(_ROW, "start", "end", "instance", "look", F.explode("contexts").alias("context"))
        .join(patterns, "context").where(_fits())
        .join(scores.where(f"score >= {MIN_SCORE}"), ["instance", "kind"])
    )
    best = Window.partitionBy(_ROW, "start", "end").orderBy(F.desc("confidence"), "kind")
    found = found.withColumn("place", F.row_number().over(best)).where("place = 1")
    return found.groupBy(_ROW).agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))


def with_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of each row with ``base`` and ``spans``, arrays of ``start, kind, end``.

    Positions count code points, the end is exclusive and kind is the place in KINDS.
    ``base`` holds the matches of the fixed patterns in the whole text, ``spans`` these and
    what bootstrapping adds. The text is read once; rows go on with their spans and
    candidates only, unless ``keep`` names it.

    A NULL or empty text has no spans. Repeated rows are treated alike. An empty
    table gives no rows. Columns not named in ``keep`` are left out.
    """
    return _spanned(docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias(_TEXT))).drop(_ROW)


def _spanned(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn(_TEXT, F.coalesce(_TEXT, F.lit(""))).withColumn(_ROW, F.monotonically_increasing_id())
    rows = stored(
        rows.withColumns({_BASE: base_spans(_TEXT), _NEAR: candidates(_TEXT)}).drop(_TEXT), "pii-rows"
    )
    joined = rows.drop(_NEAR).join(discovered(rows), _ROW, "left")
    spans = F.when(F.col("more").isNull(), F.col(_BASE)).otherwise(F.array_sort(F.concat(_BASE, "more")))
    return joined.withColumn("spans", spans).withColumnRenamed(_BASE, "base").drop("more")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span in order, joined by commas; empty without any."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = F.transform(
        spans,
        lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(one, ",")


def masked(text: str, spans: str) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap give one mark."""
    marks = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    return F.expr(
        f"""CASE WHEN size({spans}) = 0 THEN {text} ELSE transform(
          array(aggregate({spans}, named_struct('at', 0L, 'parts', CAST(array() AS array<string>)),
            (a, s) -> CASE WHEN s.start < a.at
              THEN named_struct('at', greatest(a.at, s.end), 'parts', a.parts)
              ELSE named_struct('at', s.end, 'parts', concat(a.parts, array(
                substring({text}, CAST(a.at + 1 AS INT), CAST(s.start - a.at AS INT)), {marks}[s.kind]))) END)),
          r -> concat(array_join(r.parts, ''), substring({text}, CAST(r.at + 1 AS INT), length({text}))))[0] END"""
    )


def masking(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """All rows and columns with personal data masked, and the column ``size``, if present, counted anew.

    A NULL text stays NULL.
    """
    names = docs.columns
    whole, body = "__pii_all", "__pii_body"
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias(whole), F.col(f"`{text}`").alias(_TEXT))
    rows = _spanned(rows).select(whole, "spans").withColumn(body, F.col(whole)[text])
    rows = rows.withColumn(body, masked(body, "spans"))

    def column(name: str) -> Column:
        if name == text:
            return F.col(body).alias(name)
        if name == size:
            kind = docs.schema[name].dataType
            counted = F.when(F.size("spans") > 0, F.length(body).cast(kind)).otherwise(F.col(whole)[name])
            return counted.alias(name)
        return F.col(whole)[name].alias(name)

    return rows.select(*(column(c) for c in names))
