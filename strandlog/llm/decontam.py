"""Benchmark decontamination by template windows, in DataFrame functions only.

A text becomes a template: numbers, units after numbers, and names (capitalised words) turn into typed placeholders, the
rest into lower-case words. Of an item there are up to three templates: with all capitalised words as names, with those
that open a sentence as plain words, and with no names at all, for texts in lower case or capitals. Windows of WORDS
template words are hashed and hash-joined with those of the benchmark. Matches of a document and an item on one
alignment (place in the document less place in the item) must fill the slots consistently: a value of the item stands
for one value of the document throughout, so that re-parameterised questions match and chance matches of bare templates
don't. An item counts as found if, for one of its templates, the matches of its consistent alignments cover at least
COVERAGE percent of its words, so that a changed word costs itself and not all windows over it, or if one alignment
covers RUN words in a row, at least half of them literal, however long the item is.

Texts are told apart by their MD5. Defined cases: a null or empty text has no window; an item with fewer than WORDS words
is one shorter window, looked up among windows of its own length; one item id with several texts is found if one of them
is; repeated items or rows give repeated matches once; an empty benchmark finds nothing; rows of one id are judged one by
one, rows without an id too; `clean` passes all columns through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from strandlog.llm.shared import BROADCAST_ROWS, forget, written

WORDS = 8
COVERAGE = 60
RUN = 13
#: Placeholders of the template; they are taken out of texts first.
NUMBER, UNIT, NAME = "\u0001", "\u0002", "\u0003"
UNITS = (
    "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|ft|in|l|ml|s|sec|secs|min|mins|h|hr|hrs|hour|hours|minute|minutes|second|seconds|day|days|week|weeks|month|months|year|years|percent|usd|eur|dollar|dollars|euro|euros|cent|cents|mph|kmh|"
    "mile|miles|meter|meters|metre|metres|gram|grams|liter|liters|litre|litres|kilogram|kilograms|kilometer|kilometers|kilometre|kilometres|pound|pounds|ounce|ounces|inch|inches|foot|feet|yard|yards"
)
#: (pattern, replacement in a template, replacement that marks the slot's value). Repeated groups are possessive: others
#: cost Java's matcher stack for each round, and a long run of names or numbers ends the executor. A run of digits, points
#: and commas is entered at its start only, not at each digit.
NAMES = (r"\p{Lu}(?<![\p{L}\p{M}\p{N}].)\p{Ll}++(?![\p{L}\p{M}\p{N}])(?: \p{Lu}\p{Ll}++(?![\p{L}\p{M}\p{N}]))*+", f" {NAME} ", "\u0001$0\u0003")
NAMES_INSIDE = (r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}++(?![\p{L}\p{M}\p{N}])(?: \p{Lu}\p{Ll}++(?![\p{L}\p{M}\p{N}]))*+", f" {NAME} ", "\u0001$0\u0003")
NUMBERS = (
    (rf"(?=[\p{{Nd}}.,])(?<![\p{{Nd}}.,])([.,]*+)(\p{{Nd}}[\p{{Nd}}.,]*+) ?((?i:{UNITS})\b|%)", f"$1 {NUMBER} {UNIT} ", "$1\u0002$2\u0003 \u0002=$3\u0003"),
    (r"(^|[^\p{Nd}\x{2}.,])(\p{Nd}++(?:[.,]\p{Nd}++)*+)", f"$1 {NUMBER} ", "$1\u0002$2\u0003"),
)
#: Rules in order: of documents, and the other ones of items.
RULES = (NAMES, *NUMBERS)
VARIANTS = (RULES, (NAMES_INSIDE, *NUMBERS), NUMBERS)


def _plain(text):
    return F.translate(F.coalesce(text, F.lit("")), NUMBER + UNIT + NAME, "   ")


def template(text, rules=RULES):
    """Column: array of template words."""
    out = _plain(text)
    for pattern, by, _ in rules:
        out = F.regexp_replace(out, pattern, by)
    return F.array_remove(F.split(F.lower(out), r"[^\p{L}\p{M}\p{N}\x{1}-\x{3}]+"), "")


def slots(text, rules=RULES):
    """Column: for each template word its value; null for a literal word. Names, numbers and units (with =) stand in marks."""
    out = _plain(text)
    for pattern, _, mark in rules:
        out = F.regexp_replace(out, pattern, mark)
    out = F.regexp_replace(out, "[\u0001\u0002]([^\u0003]*)\u0003", " \u0001$1\u0003 ")
    words = F.regexp_extract_all(out, F.lit("\u0001[^\u0003]*\u0003|[\\p{L}\\p{M}\\p{N}]+"), F.lit(0))
    return F.transform(words, lambda x: F.when(x.startswith("\u0001"), F.lower(x)))


def let(value, body):
    """Column: body of value, which is evaluated once and not at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows(words, widths):
    """Column: array of (at, width, window): the hashes of all windows of the widths (columns or numbers); a shorter text
    gives none."""

    def of(h, n):
        n = F.lit(n) if isinstance(n, int) else n
        found = F.transform(F.sequence(F.lit(1), F.size(h) - n + 1), lambda i: F.struct((i - 1).alias("at"), n.alias("width"), F.xxhash64(F.slice(h, i, n)).alias("window")))
        return F.when(F.size(h) >= n, found).otherwise(F.array().cast("array<struct<at: int, width: int, window: bigint>>"))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return let(hashes, lambda h: of(h, widths[0]) if len(widths) == 1 else F.concat(*(of(h, n) for n in widths)))


def templates(items: DataFrame, n: int = WORDS) -> DataFrame:
    """(item, item_id, words, item_values, width, total): a row for each different template of an item's text."""
    given = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL").distinct()
    variant = F.explode(F.array(*(F.struct(F.lit(i).alias("variant"), template(F.col("text"), r).alias("words"), slots(F.col("text"), r).alias("item_values")) for i, r in enumerate(VARIANTS))))
    out = given.select("item_id", F.md5("text").alias("text"), variant.alias("x")).select("item_id", "text", "x.*").where(F.size("words") > 0)
    out = out.groupBy("item_id", "text", "words").agg(F.min_by("item_values", "variant").alias("item_values"), F.min("variant").alias("variant"))
    out = out.withColumn("width", F.least(F.size("words"), F.lit(n))).withColumn("total", (F.size("words") - F.col("width") + 1).cast("long"))
    return out.select(F.xxhash64("item_id", "text", "variant").alias("item"), "item_id", "words", "item_values", "width", "total")


def matches(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(key, item, at, place): where a text's window equals an item's. docs: (key, text); bench: templates(). One pass over
    the texts, whatever widths the items have."""
    right = bench.select("item", F.explode(windows(F.col("words"), [F.col("width")])).alias("x")).select("item", F.col("x.at").alias("place"), "x.width", "x.window")
    widths = sorted(r["width"] for r in bench.select("width").distinct().collect())  # at most WORDS values
    right = F.broadcast(right) if right.count() <= BROADCAST_ROWS else right
    rows = docs.select("key", F.explode(windows(template(F.col("text")), widths or [WORDS])).alias("x")).select("key", "x.*")
    return rows.join(right, ["width", "window"]).select("key", "item", "at", "place")


def longest_run_found(covered, item_values, least: int = RUN):
    """Column: whether `least` item words in a row, at least half of them literal, are among the sorted places `covered`."""
    start = F.struct(F.lit(-2).alias("at"), F.lit(0).alias("words"), F.lit(0).alias("literal"), F.lit(False).alias("found"))

    def step(acc, p):
        on = p == acc["at"] + 1
        words = F.when(on, acc["words"]).otherwise(F.lit(0)) + F.lit(1)
        literal = F.when(on, acc["literal"]).otherwise(F.lit(0)) + F.get(item_values, p).isNull().cast("int")
        return F.struct(p.alias("at"), words.alias("words"), literal.alias("literal"), (acc["found"] | ((words >= least) & (literal * 2 >= words))).alias("found"))

    return F.aggregate(covered, start, step, lambda acc: acc["found"])


def found_texts(docs: DataFrame, items: DataFrame, n: int = WORDS, coverage: int = COVERAGE) -> DataFrame:
    """docs: (key, text), equal texts having equal keys. One row per key and item id that the text holds."""
    bench = written(templates(items, n), "benchmark")
    hits = written(matches(docs, bench), "matches")
    # slot values, only for texts and items that met
    near = hits.select("key").distinct()
    near = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    doc_slots = docs.join(near, "key", "left_semi").dropDuplicates(["key"]).select("key", slots(F.col("text")).alias("values"))
    lines = hits.groupBy("key", "item", (F.col("at") - F.col("place")).alias("shift")).agg(F.collect_set("place").alias("places"))  # at most the item's windows
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("width") - 1))))
    pairs = F.transform(covered, lambda p: F.struct(F.get("item_values", p).alias("i"), F.get("values", p + F.col("shift")).alias("d")))
    valued = F.array_distinct(F.filter(pairs, lambda x: x["i"].isNotNull()))
    lines = lines.join(doc_slots, "key").join(bench.drop("words"), "item").withColumn("pairs", valued)
    # consistent: as many different item values as different (item value, document value) pairs
    fine = F.size(F.array_distinct(F.transform("pairs", lambda x: x["i"]))) == F.size("pairs")
    changed = F.size(F.filter("pairs", lambda x: x["i"] != x["d"]))
    lines = lines.where(fine).select("key", "item", "item_id", "total", "width", "places", F.array_sort(covered).alias("covered"), "item_values", F.size("pairs").alias("n_slots"), changed.alias("n_changed"))
    lines = lines.withColumn("long", longest_run_found(F.col("covered"), F.col("item_values")))
    found = lines.groupBy("key", "item", "item_id").agg(
        F.max("total").alias("n_windows"), F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_matched"),
        F.max("n_slots").cast("long").alias("n_slots"), F.max("n_changed").cast("long").alias("n_changed"),
        F.max("long").alias("long"), F.size(F.array_distinct(F.flatten(F.collect_set("covered")))).alias("n_covered"), (F.max("total") + F.max("width") - 1).alias("n_words"),
    )
    found = found.where((F.col("n_covered") * 100 >= F.col("n_words") * coverage) | F.col("long"))
    best = F.max(F.struct("n_matched", "n_windows", "n_slots", "n_changed")).alias("x")
    out = written(found.groupBy("key", "item_id").agg(best).select("key", "item_id", "x.n_windows", "x.n_matched", "x.n_slots", "x.n_changed"), "contaminated")
    forget(hits)
    forget(bench)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__key", F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def contaminated(docs: DataFrame, items: DataFrame, n: int = WORDS, coverage: int = COVERAGE) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, n_windows, n_matched, n_slots, n_changed."""
    rows = keyed(docs.select("doc_id", "text"))
    found = found_texts(rows.select(F.col("__key").alias("key"), F.col("text").cast("string").alias("text")), items, n, coverage)
    right = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__key").alias("key")).join(right, "key").drop("key").distinct()


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they were."""
    rows = keyed(docs)
    found = found_texts(rows.select(F.col("__key").alias("key"), F.col("text").cast("string").alias("text")), items)
    found = found.select(F.col("key").alias("__key")).distinct()
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return rows.join(found, "__key", "left_anti").select(*docs.columns)
