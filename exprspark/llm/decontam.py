"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

A text becomes template words: numbers, names and units are typed placeholders that keep their
value, all else is lower-cased letters and digits. Windows of template words are hash-joined with the
windows of the benchmark, all of either side; each hit gives an alignment of a document with an item, on which the words
are compared one by one and the slot values checked for consistency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprspark.llm import common
from exprspark.session import cut

WINDOW = 6
#: An alignment needs so many plain words where values differ. A window is keyed by its template if it has one plain word, and by its
#: values always: what has this many plain words has some in a keyed window.
PLAIN = 4
COVERAGE = 0.6
#: Other names stand for the item's only where so many plain words agree for each of them.
PER_NAME = 2
#: From this share of words equal as values, slots need not agree.
VERBATIM = 0.9
#: Hits whose offsets lie so many words apart are judged together: words may be inserted or missing between them.
SHIFT = WINDOW
#: Benchmark windows up to which they are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Words that count as units after a number.
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons "
         "s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent degrees kmh mph usd eur dollar dollars cent cents "
         "euro euros meter meters metre metres gram grams kilogram kilograms kilometer kilometers w kw watt watts v volt volts "
         "stunde stunden tag tage woche wochen monat monate jahr jahre prozent grad heure heures jour jours semaine semaines mois ans hora horas semana semanas meses").split()

#: German articles and prepositions fused with one; a capitalised word after them is a noun.
ARTICLES = "der die das den dem des ein eine einen einem einer eines kein keine keinen keinem keiner zum zur im am vom beim ins ans".split()
#: Capitalised words that are no names at the start of a sentence.
OPENERS = ("The An If In On At It Is Are He She They We You This That These Those Each Every How What When Where Which Who Why There Then After Before And But Or So For From With To Of By As "
           "His Her Their Our My Its All Some Many Most No Not Let Find One Two").split()

NUMBER, NAME, UNIT, START = "①", "②", "③", "④"
MARKS = NUMBER + NAME + UNIT + START


def canonical(text: Column) -> Column:
    """Template words in their own case, joined by one space; a placeholder is its mark followed by its value.

    A name is a word with one leading capital that follows another word of the same sentence; at the start of a sentence such a
    word may be a name or not, and has a mark of its own, which any such word meets. A capitalised word after a German article is
    a noun, no name. A unit is a listed word after a number. Numbers keep decimal signs as underscores. Marks that stand in a text are treated like its own.
    """
    noun = rf"(?<!(?<!\p{{L}})(?:{'|'.join(f'[{w[0]}{w[0].upper()}]{w[1:]}' for w in ARTICLES)})\s)"
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?=\p{{Lu}})(?<=[^.!?\s]\s){noun}\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{Nd}}]*", f"{NAME}$0")
    t = F.regexp_replace(t, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{Nd}}_{NAME}]){noun}(?!(?:{'|'.join(OPENERS)})(?![\p{{L}}\p{{Nd}}_]))\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{Nd}}]*", f"{START}$0")
    n = F.regexp_replace(t, r"(?<=\p{Nd})[.,](?=\p{Nd})", "_")
    n = F.regexp_replace(n, r"(?=\p{Nd})(?<![\p{L}\p{Nd}_])(\p{Nd}[\p{Nd}_]*)(\p{L}{0,12})", f"{NUMBER}$1 $2")
    n = F.regexp_replace(n, rf"({NUMBER}[\p{{Nd}}_]+)\s+((?i:{'|'.join(UNITS)}))(?![\p{{L}}\p{{Nd}}_])", f"$1 {UNIT}$2")
    t = F.when(t.rlike(r"\p{Nd}"), n).otherwise(t)
    return F.trim(F.regexp_replace(t, rf"[^\p{{L}}\p{{Nd}}_{MARKS}]+", " "))


def words(line: Column) -> Column:
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def template(line: Column) -> Column:
    """The canonical line without the values of its placeholders."""
    return F.regexp_replace(line, rf"([{MARKS}])[\p{{L}}\p{{Nd}}_]*", "$1")


def values(line: Column) -> Column:
    """The canonical line without the marks of its placeholders."""
    return F.translate(line, MARKS, "")


def _window_keys(hashes: str, width: int) -> str:
    """SQL of the keys of all windows of `width` entries of an array of word hashes."""
    own = ", ".join(f"h[i + {k}]" for k in range(width))  # the hash of an array is that of its entries in order
    return (f"flatten(transform(array({hashes}), h -> if(size(h) < {width}, cast(array() as array<bigint>), "
            f"transform(sequence(0, size(h) - {width}), i -> xxhash64({own})))))")


def document_windows(docs: DataFrame, short: list[int]) -> DataFrame:
    """(text_key, pos, key) of all of each document's windows of `WINDOW` words and of the lengths in `short`: by value, and by
    template where a window holds a placeholder. A word is split off and hashed once; keys combine the hashes."""
    line = docs.select(common.text_key().alias("text_key"), canonical(F.col("text")).alias("line"))
    line = line.withColumn("line", F.when(F.col("line").rlike(r"\p{Lu}"), F.lower("line")).otherwise(F.col("line")))

    def hashes(form: Column) -> Column:
        return F.when(F.col("line") == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(form, " "), lambda w: F.xxhash64(w)))

    marked = F.col("line").rlike(f"[{MARKS}]")
    own = line.select("text_key", hashes(values(F.col("line"))).alias("v"), F.when(marked, hashes(template(F.col("line")))).alias("t"))
    out = None
    for width in [WINDOW, *short]:
        keys = own.select("text_key", F.expr(_window_keys("v", width)).alias("by_value"), F.when(F.col("t").isNotNull(), F.expr(_window_keys("t", width))).alias("by_template"))
        both = F.expr("concat(by_value, coalesce(zip_with(by_value, by_template, (a, b) -> nullif(b, a)), cast(array() as array<bigint>)))")
        each = keys.select("text_key", F.size("by_value").alias("n"), F.posexplode(both).alias("pos", "key")).where("key is not null")
        each = each.select("text_key", F.pmod("pos", "n").alias("pos"), "key")
        out = each if out is None else out.unionByName(each)
    return out


def _mark(word: str) -> str:
    return f"(left({word}, 1) in ('{NUMBER}', '{NAME}', '{UNIT}', '{START}'))"


def _arrays(line: Column) -> list[Column]:
    return [words(line).alias("words"), words(template(line)).alias("tpl"), words(values(line)).alias("vals")]


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, windows): items (item, item_id, words, tpl, vals, n, width) that have words; windows (key, item, item_pos).

    An item shorter than a window is one window of its own length.
    """
    line = F.lower(canonical(F.col("text")))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), line.alias("line")).where("line <> ''").distinct().select("item_id", *_arrays(F.col("line")))
    items = cut(items.withColumn("item", F.xxhash64("item_id", "words")).withColumn("n", F.size("words")).withColumn("width", F.least("n", F.lit(WINDOW))))
    at = items.select("item", "tpl", "vals", "width", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width"))).alias("item_pos"))
    at = at.withColumn("own", F.expr("slice(tpl, item_pos + 1, width)"))
    plain = F.expr(f"size(filter(own, w -> not {_mark('w')}))")
    templated = F.when(plain >= 1, F.expr("xxhash64(transform(own, w -> xxhash64(w)))"))
    by_value = F.expr("xxhash64(transform(slice(vals, item_pos + 1, width), w -> xxhash64(w)))")
    return items, cut(at.select(F.explode(F.array_distinct(F.array_compact(F.array(templated, by_value)))).alias("key"), "item", "item_pos"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, text) and benchmark item that it contains, perhaps with other numbers, names or units:
    doc_id, text_key, item_id, at (word where the item would start), matched, item_words, coverage, slots, same_values.

    An item is contained if at one alignment at least `COVERAGE` of its words are equal, as templates or as values, and the
    slots agree: equal item values stand for equal document values and different ones for different ones. Where fewer
    than `PLAIN` plain words agree, or fewer than `PER_NAME` for each name that differs, the values themselves must be equal. Alignments are found by a window of `WINDOW` words at any place of the document that
    equals a window at any place of the item; an item shorter than that is one window. Null and empty texts contain nothing and are
    contained in nothing. Hits of one item at most `SHIFT` words apart are one alignment, whose equal words are united. From `VERBATIM` of
    equal words on, slots need not agree. Repeated rows count once.
    """
    items, keys = benchmark_windows(benchmark)
    short = sorted(r["width"] for r in items.where(F.col("n") < WINDOW).select("width").distinct().collect())  # at most WINDOW rows
    at = document_windows(docs, short)
    side = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    found = cut(at.join(side, "key").select("text_key", "item", (F.col("pos") - F.col("item_pos")).alias("at")).distinct())
    # each hit with those at offsets near its own
    nearby = found.select("text_key", "item", F.explode(F.sequence(F.col("at") - SHIFT, F.col("at") + SHIFT)).alias("center"), "at").groupBy("text_key", "item", "center").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    found = nearby.where(F.array_contains("ats", F.col("center"))).withColumn("at", F.element_at("ats", 1)).select("text_key", "item", "at", "ats").distinct()

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_key().alias("text_key"), "text")
    pairs = found.join(items.select("item", "item_id", F.col("words").alias("iw"), F.col("tpl").alias("it"), F.col("vals").alias("iv"), "n"), "item")
    hit = texts.join(found.select("text_key").distinct(), "text_key", "left_semi").withColumn("line", F.lower(canonical(F.col("text"))))
    hit = cut(hit.select("doc_id", "text_key", words(template(F.col("line"))).alias("dt"), words(values(F.col("line"))).alias("dv")))  # their words are made once
    both = hit.join(pairs, "text_key")
    both = both.select("doc_id", "text_key", "item_id", "at", "n", F.expr(
        f"""filter(transform(sequence(0, n - 1), i -> named_struct('i', iv[i], 'd', coalesce(
              try_element_at(filter(transform(ats, a -> get(dv, a + i)), d -> d <=> iv[i]), 1), get(dv, try_element_at(filter(ats, a -> it[i] <=> get(dt, a + i)), 1) + i)),
            'typed', exists(ats, a -> it[i] <=> get(dt, a + i)), 'slot', {_mark('iw[i]')}, 'wild', left(iw[i], 1) = '{START}', 'name', left(iw[i], 1) in ('{NAME}', '{START}'))), p -> p.typed or p.i <=> p.d)""").alias("same"))
    slots = F.expr("array_distinct(transform(filter(same, p -> p.slot and p.typed and not p.wild), p -> named_struct('i', p.i, 'd', p.d)))")
    judged = both.withColumn("pairs", slots).withColumn("matched", F.size("same")).withColumn("plain", F.expr("size(filter(same, p -> not p.slot))")).withColumn("differ", F.expr("size(filter(same, p -> p.i <> p.d))"))
    judged = judged.withColumn("renamed", F.expr("size(array_distinct(transform(filter(same, p -> p.name and p.i <> p.d), p -> p.i)))"))
    consistent = F.expr("size(pairs) = size(array_distinct(transform(pairs, p -> p.i))) and size(pairs) = size(array_distinct(transform(pairs, p -> p.d)))")
    verbatim = (F.col("matched") - F.col("differ")) / F.col("n") >= VERBATIM
    good = judged.withColumn("coverage", F.col("matched") / F.col("n")).where((F.col("coverage") >= COVERAGE) & (consistent | verbatim) & (((F.col("plain") >= F.least(F.lit(PLAIN), F.col("n"))) & (F.col("plain") >= PER_NAME * F.col("renamed"))) | (F.col("differ") == 0)))
    best = F.max_by(F.struct("at", "matched", F.col("n").alias("item_words"), "coverage", F.size("pairs").alias("slots"), (F.col("differ") == 0).alias("same_values")),
                    F.struct("matched", -F.col("differ"), -F.col("at")))
    return good.groupBy("doc_id", "text_key", "item_id").agg(best.alias("b")).select("doc_id", "text_key", "item_id", "b.*")
