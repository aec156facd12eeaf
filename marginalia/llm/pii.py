"""Operator 5: personal data, by patterns and by bootstrapped contextual extraction, in Spark expressions alone.

Base entities (emails, IP addresses, card and phone numbers) are found by regular expressions with checks. They are the
seeds: the two words before a seed (one, if the text has no more) are a lexical pattern, in which an instance stands as #.
Instances are whole entities: a number as international phones are written, 12 to 19 digits in groups, or else a
word that holds a digit or @, without the punctuation around it. Patterns and instances form a graph, and in each round a
pattern's confidence is the mean score of its distinct labelled instances: seeds have 1, instances of an entity's full shape that
its check refuses have 0, others are left out until a pattern has reached them. Patterns of at least SUPPORT summed
score and confidence SURE are sure, and stay so with the confidence that made them sure. An instance's score is the noisy-or of
its sure patterns' confidences, so scores only rise, and rounds go on until no pattern becomes sure. Instances that reach
SURE are spans of kind `context` wherever they follow a sure pattern and touch no base entity; one with fewer than `least`
letters and digits (LEAST, a parameter) is none, unless it holds an @: page and list numbers follow many contexts.

Offsets come from the texts between matches (split and extract_all cut alike). The expressions are possessive and look
behind, so that their time is linear in a text's length however its characters run on; they match what the plain
forms in PLAIN match. Texts are read once; what goes on to the rounds are instances with their contexts.

Cases: null or empty text: no spans; nulls elsewhere: no matter; repeated rows: each gets its spans, its instances
count once (values are distinct); an empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import every, free, saved, table

KINDS = ("email", "ip", "card", "phone")
#: The entities as stated; EXACT matches the same spans in linear time.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EXACT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": PLAIN["phone"],
}
#: What a text must hold for a kind to be looked for.
SIGN = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -][0-9]", "phone": r"\+[0-9]"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A number as international phones are written; 12 to 19 digits in groups; a word with a digit or @.
INSTANCE = (
    r"(?<![^\x20\x09-\x0D])(?:"
    r"\+[0-9][\x20().0-9-]+[0-9](?![^\x20\x09-\x0D.,;:!?)])|"
    r"[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9]|[\x20-][0-9])(?![^\x20\x09-\x0D.,;:!?)])|"
    r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
)
#: Punctuation before and after what is written in a word.
OPENING, CLOSING = r"^[(\[{<\"']+", r"[.,;:!?)\]}>\"']+$"
#: The full shape of an address or card, or of an international number.
SHAPED = r"^[0-9]+(?:\.[0-9]+){3}$|^(?:[0-9][\x20-]?){15,18}[0-9]$|^\+[0-9][\x20().0-9-]+[0-9]$"
SUPPORT = 3.0
SURE = 0.8
#: A found instance has at least so many letters and digits, or an @.
LEAST = 4
#: Code points of a part of a text that is being redacted.
PAGE = 4_096


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x computed once."""
    return F.transform(F.array(x), then)[0]


def running(x: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Of an array of whole numbers what add makes of each and all before it: within parts of about as many as there are parts, then across."""

    def scan(a: Column) -> Column:
        none = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("all"))
        step = lambda acc, v: let(add(acc["now"], v), lambda n: F.struct(n.alias("now"), F.concat(acc["all"], F.array(n)).alias("all")))
        return F.aggregate(a, none, step, lambda acc: acc["all"])

    def parted(a: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
        parts = let(size, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / n).cast("int") - 1, F.lit(0))), lambda i: scan(F.slice(a, i * n + 1, n))))
        return let(parts, lambda p: let(scan(F.transform(p, lambda c: F.coalesce(F.get(c, F.size(c) - 1), F.lit(0)))), lambda ends: F.flatten(F.transform(p, lambda c, i: F.transform(c, lambda v: add(F.when(i > 0, F.get(ends, i - 1)).otherwise(0), v))))))

    return let(x, parted)


def placed(text: Column, pattern: str, context: bool = False) -> Column:
    """The pattern's matches: array<struct<start,end,value(,before)>> in code points; before: up to two words before a match that is a word."""

    def last(words: Column) -> Column:
        return F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))

    def before(words: Column, i: Column) -> Column:
        """The two words before match i, of which earlier matches are #; words: the last two of each gap."""
        mark, none = F.array(F.lit("#")), F.array().cast("array<string>")
        earlier = F.concat(F.when(i > 1, mark).otherwise(none), F.when(i > 0, F.concat(F.get(words, i - 1), mark)).otherwise(none))
        return last(F.concat(earlier, F.get(words, i)))

    def of(values: Column, gaps: Column) -> Column:
        ends = running(F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.length(v) + F.length(g)), lambda x, y: x + y)
        words = F.transform(gaps, lambda g: last(F.filter(F.split(g, r"[\x20\x09-\x0D]+"), lambda w: w != ""))) if context else F.lit(0)

        def span(v: Column, i: Column, end: Column, words: Column) -> Column:
            parts = [(F.get(end, i) - F.length(v)).alias("start"), F.get(end, i).alias("end"), v.alias("value")]
            return F.struct(*parts, *([before(words, i).alias("before")] if context else []))

        return let(ends, lambda e: let(words, lambda w: F.transform(values, lambda v, i: span(v, i, e, w))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: let(F.split(text, pattern, -1), lambda g: of(v, g)))


def luhn(value: Column) -> Column:
    """Whether 16 to 19 digits pass the checksum."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(d == "", 0).otherwise(d.cast("int")) * (1 + i % 2))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return F.when(n.between(16, 19), total % 10 == 0).otherwise(False)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base entities by kind, then start: array<struct<kind,start,end>>."""

    def of(kind: str) -> Column:
        found = F.filter(placed(text, EXACT[kind]), lambda s: valid(kind, s["value"]))
        named = F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
        return F.when(text.rlike(SIGN[kind]), named).otherwise(none)

    return F.concat(*map(of, KINDS))


def is_base(value: Column) -> Column:
    """Whether a whole value is a base entity."""
    return F.coalesce(reduce(Column.__or__, [value.rlike(f"^(?:{PLAIN[k]})$") & valid(k, value) for k in KINDS]), F.lit(False))


def _instances(text: Column) -> Column:
    """Instances: place, value, and the pattern before."""

    def trimmed(s: Column) -> Column:
        tail = F.regexp_replace(s["value"], OPENING, "")
        start, value = s["end"] - F.length(tail), F.regexp_replace(tail, CLOSING, "")
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.lower(F.array_join(s["before"], " ")).alias("pattern"))

    return F.transform(placed(text, INSTANCE, context=True), trimmed)


def confident(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (pattern, value) -> patterns (pattern, confidence) and instances (value, score, seed) once no pattern becomes sure any more."""
    graph = saved(edges.where("pattern <> ''").distinct())
    seeds = graph.select("value").distinct()
    seeds = saved(seeds.select("value", F.when(is_base(F.col("value")), F.lit(1.0)).when(F.col("value").rlike(SHAPED), F.lit(0.0)).alias("known")))
    scores, patterns = seeds.select("value", "known", F.col("known").alias("score")), None
    while True:
        rated = graph.join(scores, "value").groupBy("pattern").agg(F.sum("score").alias("support"), F.avg("score").alias("confidence"))
        new = rated.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= SURE)).select("pattern", "confidence")
        new = saved(new if patterns is None else new.join(patterns.select("pattern"), "pattern", "left_anti"))
        none_new = new.isEmpty()
        patterns = new if patterns is None else saved(patterns.union(new))
        if none_new:
            break
        miss = F.exp(F.sum(F.log(F.lit(1.0) - F.least("confidence", F.lit(0.999)))))
        reached = graph.join(patterns, "pattern").groupBy("value").agg((F.lit(1.0) - miss).alias("reached"))
        scores = saved(seeds.join(reached, "value", "left").select("value", "known", F.coalesce("known", "reached").alias("score")))
    return patterns, scores.select("value", "score", F.coalesce(F.col("known") == 1, F.lit(False)).alias("seed"))


def _clear_of(found: DataFrame, base: DataFrame) -> DataFrame:
    """The spans of found (doc_id, key, start, end) that touch none of base, by their order."""
    kinds = ["doc_id", "key", "start", "end", "old"]
    rows = found.withColumn("old", F.lit(False)).select(*kinds).distinct().union(base.withColumn("old", F.lit(True)).select(*kinds))
    order = Window.partitionBy("doc_id", "key").orderBy("start", "end")
    ended = F.max(F.when(F.col("old"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begins = F.min(F.when(F.col("old"), F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("ended", ended).withColumn("begins", begins)
    return rows.where(~F.col("old") & (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("begins") >= F.col("end"), F.lit(True))))


def find_pii(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, key (of the text), base and found: arrays of struct<kind,start,end>."""
    text = F.coalesce("text", F.lit(""))
    words = F.when(text.rlike("[0-9@]"), _instances(text))
    rows = saved(docs.select("doc_id", F.xxhash64("text").alias("key"), base_spans(text).alias("base"), words.alias("words")))
    words = rows.where(F.size("words") > 0).select("doc_id", "key", F.explode("words").alias("w")).select("doc_id", "key", "w.*").where("value <> ''")
    patterns, scores = confident(words.select("pattern", "value"))
    enough = (F.length(F.regexp_replace("value", r"[^\p{L}\p{N}]", "")) >= least) | F.col("value").contains("@")
    sure = scores.where((F.col("score") >= SURE) & ~F.col("seed")).select("value").where(enough)
    new = words.join(patterns.select("pattern"), "pattern").join(sure, "value").select("doc_id", "key", "start", "end")
    new = saved(new.withColumn("doc_id", F.col("doc_id").cast("string")))
    where = new.select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct()
    mine = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "key", "base").dropDuplicates(["doc_id", "key"])
    mine = mine.join(where, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi")
    base = mine.select("doc_id", "key", F.explode("base").alias("s")).select("doc_id", "key", "s.start", "s.end")
    span = F.struct(F.lit("context").alias("kind"), F.col("start"), F.col("end"))
    found = _clear_of(new, base).groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.array_sort(F.collect_set(span)).alias("found"))
    out = rows.join(found, rows["doc_id"].cast("string").eqNullSafe(found["d"]) & (rows["key"] == found["k"]), "left")
    return out.select("doc_id", "key", "base", F.coalesce("found", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("found"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; n_chars, if there, is counted anew.

    Of spans that touch, the first names what replaces them all.
    """
    of, text_key, key, every_span = free(docs, "span_of", "span_text", "text_key", "spans")
    spans = find_pii(docs.select("doc_id", "text")).dropDuplicates(["doc_id", "key"])
    ordered = F.array_sort(F.transform(F.concat("base", "found"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"), s["end"].alias("end"))))
    spans = spans.select(F.col("doc_id").alias(of), F.col("key").alias(text_key), ordered.alias(every_span)).where(F.size(every_span) > 0)
    joined = docs.withColumn(key, F.xxhash64("text")).join(spans, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(key) == F.col(text_key)), "left")

    def between(pages: Column, a: Column, b: Column) -> Column:
        """The text from a to b, from its pages: a place in a string is found by counting from its beginning."""

        def part(k: Column) -> Column:
            first = F.greatest(a - k * PAGE, F.lit(0))
            return F.substr(F.get(pages, k), first + 1, F.least(b - k * PAGE, F.lit(PAGE)) - first)

        return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / PAGE).cast("int"), F.floor((b - 1) / PAGE).cast("int")), part), "")).otherwise("")

    def clean(pages: Column, all_spans: Column, ends: Column) -> Column:
        """What is between the spans, with their kinds; those that begin before an earlier one's end only lengthen it."""

        def piece(s: Column, i: Column) -> Column:
            done = F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
            return F.when(s["start"] >= done, F.concat(between(pages, done, s["start"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise("")

        return F.concat(F.array_join(F.transform(all_spans, piece), ""), between(pages, F.get(ends, F.size(ends) - 1), F.length("text")))

    pages = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))
    new = let(F.col(every_span), lambda a: let(running(F.transform(a, lambda s: s["end"]), F.greatest), lambda ends: let(pages, lambda p: clean(p, a, ends))))
    out = joined.withColumn("text", F.when(F.col(every_span).isNotNull(), new).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(every_span).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*every(docs))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "found")).alias("spans"))
